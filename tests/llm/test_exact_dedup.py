import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.exact_dedup import exact_dedup, folded_sha256, keep_last


def fold(text):
    return (text or "").encode().lower().decode()  # bytes.lower touches A-Z only


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


def weak(text):
    return F.substring(folded_sha256(text), 1, 1)


@pytest.mark.parametrize("digest", [folded_sha256, weak])
def test_against_brute_force(hard, digest):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = sorted(map(tuple, exact_dedup(hard.repartition(5), salts=3, digest=digest).collect()), key=str)
    if digest is weak:  # texts that share a digest are told apart by content
        assert sorted((g[:4] for g in got), key=str) == sorted((w[:4] for w in brute(rows)), key=str)
    else:
        assert got == brute(rows)


def test_large_group(spark):
    docs = spark.range(30000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'Same TEXT', concat('t', id)) AS text")
    rows = exact_dedup(docs.repartition(16)).where("group_size > 1")
    assert rows.agg(F.count("*"), F.min("keep_id"), F.max("keep_id"), F.sum(F.col("kept").cast("int"))).first()[:] == (
        10000, 29997, 29997, 1,
    )


def test_keep_last_keeps_rows_whole(hard):
    kept = keep_last(hard)
    assert kept.columns == hard.columns
    rows = {(r.doc_id, r.text) for r in hard.collect()}
    stay = {(i, digest) for i, _, _, kept, digest in brute(rows) if kept}
    want = {(i, fold(t)) for i, t in rows if (i, hashlib.sha256(fold(t).encode()).hexdigest()) in stay}
    assert sorted(((r.doc_id, fold(r.text)) for r in kept.collect()), key=str) == sorted(want, key=str)
