"""Merkle manifest of a dataset, as a rollup of nested structs.

A leaf is the digest of a row; leaves of a group stand in order of id, and every ``FAN`` consecutive nodes become
their parent until one is left. Ranks are written as digits to the base ``FAN``. Within a block of ``FAN ** DIGITS``
ranks the digit columns are grouped away one after the other, last digit first, and each grouping nests the children
of a node as an array of structs. A block is one row of bounded size that holds its whole subtree. Block roots are the
leaves of the next round, so a group of any size takes as many rounds as its logarithm. On the way back a block is
grouped together with the path above it, and transforms and explodes unfold its subtree into one proof per leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import stored

FAN = 16
DIGITS = 3
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def encoded(value: Column) -> Column:
    """A value that can't run into the next one: byte count, colon, text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` within ``grp`` and ``n``, the size of the group.

    Rows are dealt by range over group and order, so a group of any size is spread and sorted by all tasks. Equal
    rows are dealt by their place in the input, which must be a stored table.
    """
    by = [F.col(c).asc_nulls_first() for c in ("grp", *order, "tie")]
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    placed = stored(placed.drop("tie"), "merkle-order")
    # One row for each group of a partition: at most as many as there are partitions and groups.
    counts = placed.groupBy("grp", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    group = Window.partitionBy("grp")
    before = F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n")
    )
    return placed.join(offsets, ["grp", "part"]).withColumn("rank", F.col("place") + F.col("shift"))


def _parent(kids: Column, level: int) -> Column:
    """The digest over the children; a level that a small group doesn't have passes its only node on."""
    joined = F.array_join(F.transform(kids, lambda k: k["hash"]), "")
    return F.when(F.col("n") > FAN**level, F.sha2(joined, 256)).otherwise(kids[0]["hash"])


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of ``nodes`` (``grp``, ``rank``, ``n``, ``hash``, ``item``): ``hash`` and nested ``kids``."""
    digits = [f"digit{k}" for k in range(DIGITS)]
    values = {d: F.pmod(F.shiftright("rank", 4 * k), F.lit(FAN)).cast("int") for k, d in enumerate(digits)}
    rows = nodes.withColumns(values | {"block": F.shiftright("rank", 4 * DIGITS)}).withColumnRenamed("item", "kids")
    # Placed by block, so that no grouping needs an exchange of its own.
    rows = rows.repartition("grp", "block")
    for k, digit in enumerate(digits):
        child = F.struct(F.col(digit).alias("digit"), "hash", "kids")
        left = ["grp", "n", "block", *digits[k + 1 :]]
        rows = rows.groupBy(*left).agg(F.sort_array(F.collect_list(child)).alias("kids"))
        rows = rows.select(*left, "kids", _parent(F.col("kids"), k).alias("hash"))
    return stored(rows, "merkle-blocks")


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of ``nodes``, blocks of their roots and so on, until every group is one block."""
    rounds = [_blocks(nodes)]
    while not rounds[-1].where(F.col("n") > BLOCK).isEmpty():
        rounds.append(
            _blocks(
                rounds[-1].select(
                    "grp",
                    F.col("block").alias("rank"),
                    F.ceil(F.col("n") / BLOCK).alias("n"),
                    "hash",
                    F.struct("grp", "block").alias("item"),
                )
            )
        )
    return rounds


def _with_siblings(level: int) -> Column:
    """The children of a node, each with the digests left and right of it; null where the level doesn't exist."""
    kids = F.col("kids")

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda k: k["hash"]), "")

    def placed(kid: Column, i: Column) -> Column:
        left, right = joined(F.slice(kids, F.lit(1), i)), joined(F.slice(kids, i + 2, F.lit(FAN)))
        step = F.when(F.col("n") > FAN**level, F.struct(left.alias("left"), right.alias("right")))
        return F.struct(kid["hash"].alias("hash"), kid["kids"].alias("kids"), step.alias("step"))

    return F.transform(kids, placed)


def _unfolded(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """One row per child of the blocks: ``item``, ``hash``, its ``path`` to the top, and ``roots``.

    ``above`` has ``grp``, ``block``, ``path`` and ``roots`` for each block. The two rows of a block meet in a grouping.
    """
    none = F.lit(None)
    subtree = blocks.select("grp", "block", "n", "kids", none.cast(PATH).alias("path"), none.cast(_ROOTS).alias("roots"))
    kids_type = blocks.schema["kids"].dataType
    upper = above.select("grp", "block", none.cast("long").alias("n"), none.cast(kids_type).alias("kids"), "path", "roots")
    met = ("n", "kids", "path", "roots")
    rows = subtree.unionByName(upper).groupBy("grp", "block").agg(*(F.first(c, True).alias(c) for c in met))
    for level in reversed(range(DIGITS)):
        steps = [f"step{k}" for k in range(level + 1, DIGITS)]
        rows = rows.select("n", "path", "roots", *steps, F.explode(_with_siblings(level)).alias("kid")).select(
            "n", "path", "roots", *steps, "kid.hash", "kid.kids", F.col("kid.step").alias(f"step{level}")
        )
    own = F.filter(F.array(*(f"step{k}" for k in range(DIGITS))), lambda s: s.isNotNull())
    return rows.select(F.col("kids").alias("item"), "hash", F.concat(own, "path").alias("path"), "roots")


_ROOTS = "struct<subroot:string,root:string>"


def _proofs(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The rows of ``_unfolded`` for the nodes of the first round, from the paths above the last."""
    for blocks in reversed(rounds[1:]):
        top = _unfolded(blocks, top).select("item.grp", "item.block", "path", "roots")
    return _unfolded(rounds[0], top)


def manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    carry: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per input row: ``id_col``, the columns of ``carry``, ``leaf``, ``path``, ``subroot``, ``root``.

    A leaf is the SHA-256 of the ``fields``, each as byte count, colon and value, a null as ``-``. Per group
    (``group_col``; null is one) leaves ascend by id and ``FAN`` consecutive nodes, fewer at the end, become their
    digest until one is left, the subroot. Subroots in byte order of their group, null first, likewise give the
    root. ``path`` holds the siblings left and right of each node on the way from leaf to root: ``fold(leaf, path)``
    is the root. ``carry`` names columns over ``docs`` that travel with their leaf.

    Null ids stand first, equal ids in order of their leaves, and rows equal in all ``fields`` take any order: their
    proofs are those of the same places. Empty and very long texts are values like others. An empty table gives an
    empty manifest. Other columns of ``docs`` are not read. Nothing longer than one text or one block is held.
    """
    kept = F.struct(F.col(id_col).alias("id"), *(c.alias(f"carry{i}") for i, c in enumerate((carry or {}).values())))
    leaves = stored(
        docs.select(
            encoded(F.col(group_col)).alias("grp"),
            F.col(group_col).cast("string").alias("label"),
            leaf_digest(*map(F.col, fields)).alias("hash"),
            kept.alias("item"),
            F.col(id_col).alias("id"),
        ),
        "merkle-leaves",
    )
    rounds = _grown(_ranked(leaves.drop("label"), ["id", "hash"]).select("grp", "rank", "n", "hash", "item"))
    labels = leaves.groupBy("grp").agg(F.max("label").alias("label"))
    subroots = rounds[-1].join(labels, "grp").select(
        F.lit("").alias("grp"), "label", "hash", F.struct(F.col("grp").alias("grp")).alias("item")
    )
    sources = _grown(_ranked(stored(subroots, "merkle-subroots"), ["label"]).select("grp", "rank", "n", "hash", "item"))
    root = F.struct(F.lit(None).cast("string").alias("subroot"), F.col("hash").alias("root"))
    top = sources[-1].select("grp", "block", F.array().cast(PATH).alias("path"), root.alias("roots"))
    top = _proofs(sources, top).select(
        "item.grp",
        F.lit(0).cast("long").alias("block"),
        "path",
        F.struct(F.col("hash").alias("subroot"), F.col("roots.root").alias("root")).alias("roots"),
    )
    carried = [F.col(f"item.carry{i}").alias(name) for i, name in enumerate(carry or {})]
    return _proofs(rounds, top).select(
        F.col("item.id").alias(id_col), *carried, F.col("hash").alias("leaf"), "path", "roots.subroot", "roots.root"
    )
