"""SimHash near-duplicates by covering locality-sensitive hashing.

Each of ``2^(radius+1) - 1`` tables keeps the bits of one structured mask. Two fingerprints that differ in at
most ``radius`` bits agree on at least one mask, so every link shows as a shared bucket, whatever the data.
Inside the shared buckets, links are found without comparing pairs: two fingerprints are at most two bits apart
exactly if changing at most one bit of each can make them equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, same, stored

SHINGLE = 3
RADIUS = 2
BITS = 64
# Hashes of one text that are counted together.
CHUNK = 1 << 15


def fingerprint_of(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """Majority of the bits of all shingle hashes; zero without words."""
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(last)
    for at in range(0, n, CHUNK):
        hashes = [digest(text[a:b], seed) for a, b in zip(starts[at : at + CHUNK], last[at : at + CHUNK])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(text: Column | str, shingle: int = SHINGLE) -> Column:
    """The 64-bit fingerprint of a text as a signed long.

    Words are what stands between ASCII white space, with A-Z in lower case; shingles of ``shingle`` words,
    repeats included, are hashed with XXH64 and seed 42. Fewer words are one shingle; a text without words, or
    null, has fingerprint zero.
    """

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            folded = pc.ascii_lower(pc.fill_null(batch, ""))
            made = [fingerprint_of(t.as_buffer().to_pybytes().split(), shingle) for t in folded]
            yield pa.array(np.array(made, np.uint64).view(np.int64))

    return fingerprints(F.col(text).cast("string") if isinstance(text, str) else text)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks as signed longs such that any ``radius`` positions are all outside some mask.

    Position i gets the non-zero vector 1 + i mod (2^(radius+1) - 1); mask v holds the positions whose vector
    has an odd product with v. ``radius`` vectors never span all radius + 1 dimensions, so some v is orthogonal
    to all of them.
    """
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(bits) if (1 + i % n & v).bit_count() & 1)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints (column ``fp``), enough to connect all that are linked.

    Each edge joins fingerprints at most ``radius`` bits apart (``radius`` 0 to 2), and two fingerprints that are
    linked are joined by one or two edges.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    masks = F.array(*(F.lit(m).cast("long") for m in covering_masks(radius)))
    rows = prints.select("fp", F.explode(masks).alias("mask")).withColumn("bucket", F.expr("fp & mask"))
    shared = stored(
        rows.groupBy("mask", "bucket")
        .agg(F.min("fp").alias("low"), F.max("fp").alias("high"))
        .where("low < high")
        .select("mask", "bucket"),
        "buckets",
    )
    # Bits that any of its shared buckets leaves open: a linked fingerprint differs in these only.
    open_bits = rows.join(shared, ["mask", "bucket"], "left_semi").groupBy("fp").agg(F.expr("bit_or(~mask)").alias("open"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)))
    near = open_bits.select("fp", F.explode(F.filter(flips, lambda b: b.bitwiseAND(F.col("open")) == b)).alias("flip"))
    if radius == 2:
        meeting = near.select("fp", F.expr("fp ^ flip").alias("at"))
        # At most 65 fingerprints are within one bit of a meeting point, and all of these are within two of another.
        groups = meeting.groupBy("at").agg(F.collect_set("fp").alias("fps")).where("size(fps) > 1")
        return (
            groups.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a <> b").select("a", "b").distinct()
        )
    found = near.where("flip <> 0").select(F.col("fp").alias("a"), F.expr("fp ^ flip").alias("b"))
    other = prints.select(F.col("fp").alias("b"))
    return found.join(other, "b", "left_semi").select("a", "b") if radius else found.where("false")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root``: the smallest node of its component, for every node of an edge.

    Alternating large-star and small-star steps, each a minimum per node and a join. Both sides of the joins are
    stored tables, so adaptive execution can split a node with many edges.
    """

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            seen = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            seen = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = stored(seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        joined = seen.join(low, "a")
        if larger:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
            moved = moved.unionByName(low.select("a", F.col("low").alias("b")))
        return stored(moved.where("a <> b").distinct(), "edges")

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        edges = star(star(edges, larger=True), larger=False)
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (16 hex digits), ``component_id``.

    Documents are linked when their fingerprints differ in at most ``radius`` bits; ``component_id`` is the
    smallest id that can be reached, its own included (null if all of these are null). Null, empty and white
    texts have fingerprint zero and are linked like others. Repeated rows get equal results, an empty table an
    empty one; other columns are not read.
    """
    prints = stored(docs.select(F.col(id_col).alias("id"), simhash(text_col, shingle).alias("fp")), "prints")
    return _components_of(prints, radius).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _components_of(prints: DataFrame, radius: int) -> DataFrame:
    """``id``, ``fp``, ``component_id`` and ``first_fp``, the smallest fingerprint under that id in the component."""
    classes = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "classes")
    roots = components(links(classes.select("fp"), radius))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    linked = stored(linked, "linked")
    lowest = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "fp")))
    named = linked.groupBy("root").agg(lowest.alias("low"))
    named = stored(named.select("root", F.col("low.first").alias("component_id"), F.col("low.fp").alias("first_fp")), "named")
    by_print = stored(linked.join(named, "root").select("fp", "component_id", "first_fp"), "by-print")
    return prints.join(by_print, "fp").select("id", "fp", "component_id", "first_fp")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: of those with the smallest id one with the
    smallest fingerprint.

    A component without any id keeps its rows. The documents are stored with their fingerprints, so that each is
    computed once.
    """
    name, fp = fresh(docs, "component_of"), fresh(docs, "fp")
    marked = stored(docs.withColumns({name: F.col(id_col), fp: simhash(text_col, shingle)}), "marked", "zstd")
    found = stored(_components_of(marked.select(F.col(name).alias("id"), F.col(fp).alias("fp")), radius), "components")
    found = found.withColumnsRenamed({"id": name, "fp": fp})
    stays = F.col(name).eqNullSafe(F.col("component_id")) & F.coalesce(F.col(fp) == F.col("first_fp"), F.lit(True))
    dropped = found.where(~stays).select(name, fp).distinct()
    rest = marked.join(dropped, same(marked, dropped, [name, fp]), "left_anti")
    if not found.where(stays & F.col(name).isNotNull()).groupBy(name, fp).count().where("count > 1").isEmpty():
        named = rest.where(F.col(name).isNotNull()).dropDuplicates([name, fp])
        rest = named.unionByName(rest.where(F.col(name).isNull()))
    return rest.drop(name, fp)
