import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import merkle_manifest
from tallyframe.llm.merkle_manifest import FIELDS, fold, leaf_digest, manifest, path_digest

NAMES = ("doc_id", "leaf", "path", "subroot", "root")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes, fan=16):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
    return out


def path(tree, at, fan=16):
    out = []
    for nodes in tree[:-1]:
        low = at // fan * fan
        out.append(("".join(nodes[low:at]), "".join(nodes[at + 1 : low + fan])))
        at //= fan
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
    trees = [levels([x[2] for x in groups[name]]) for name in names]
    top = levels([t[-1][0] for t in trees])
    return sorted(
        (
            (x[3][0], x[2], tuple(path(tree, i) + path(top, g)), tree[-1][0], top[-1][0])
            for g, (name, tree) in enumerate(zip(names, trees, strict=True))
            for i, x in enumerate(groups[name])
        ),
        key=str,
    )


def result(df):
    return sorted(
        ((r.doc_id, r.leaf, tuple((s.left, s.right) for s in r.path), r.subroot, r.root) for r in df.collect()), key=str
    )


def check(docs):
    got = result(manifest(docs).select(*NAMES))
    assert got == brute([tuple(r) for r in docs.select(*FIELDS).collect()])
    return got


def test_hot_source_and_several_rounds(spark):
    """One source has most of the rows and takes two rounds of blocks; others have 1, 16, 17 and 257 leaves."""
    source = F.expr(
        "CASE WHEN id < 9000 THEN 'hot' WHEN id = 9000 THEN 'one' WHEN id <= 9016 THEN NULL WHEN id <= 9033 THEN 'é' "
        "WHEN id <= 9290 THEN 'Z' ELSE concat('s', id % 40) END"
    )
    docs = spark.range(9500).select(
        (9500 - F.col("id")).alias("doc_id"),
        source.alias("source"),
        F.when(F.col("id") % 5 != 0, "en").alias("lang"),
        F.length(F.col("id").cast("string")).cast("long").alias("n_chars"),
        F.concat(F.lit("Text é "), F.col("id").cast("string")).alias("text"),
    )
    got = check(docs.repartition(7))
    assert max(len(r[2]) for r in got) == 6  # 9000 leaves: four levels; 45 sources: two


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, n):
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), *(F.lit(None).cast("string").alias(c) for c in FIELDS[1:])
    )
    assert len(check(docs)) == n


def test_hard_rows(spark, hard):
    """Null ids and texts, empty and very long texts, repeated rows, and columns named like those of the operator."""
    docs = hard.withColumns(
        {c: F.lit("x") for c in ("grp", "hash", "item", "rank", "n", "block", "path", "label", "tie", "digit0", "kids")}
    )
    docs = docs.withColumns({"source": F.lit(None).cast("string"), "lang": F.lit(""), "n_chars": F.lit(3)})
    assert len(check(docs.unionByName(docs.limit(4)).repartition(3))) == docs.count() + 4


def test_fold_finds_a_changed_row(spark):
    docs = spark.range(600).selectExpr(
        "id AS doc_id", "concat('s', id % 3) AS source", "'en' AS lang", "1 AS n_chars", "concat('t', id) AS text"
    )
    fields = [F.lit("other") if c == "text" else F.col(c) for c in FIELDS]
    out = manifest(docs, carry={"other": leaf_digest(*fields)}).select(
        (fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("own"),
        (fold(F.col("other"), F.col("path")) == F.col("root")).alias("changed"),
        path_digest(F.col("path")).alias("proof"),
    )
    assert out.agg(F.every("own"), F.some("changed"), F.count_distinct("proof")).first()[:] == (True, False, 600)


def test_order_of_input_does_not_matter(documents):
    docs = documents.limit(150)
    root = {r.root for r in manifest(docs).collect()} | {r.root for r in manifest(docs.repartition(5, "text")).collect()}
    assert len(root) == 1


def test_no_window_or_collect_over_a_group(documents):
    """Rows of a group are never in one task as such: the plan partitions by block."""
    plan = manifest(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Window" not in plan and "Cartesian" not in plan
    assert merkle_manifest.BLOCK == 4096
