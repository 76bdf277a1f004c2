"""Packing by optimal length buckets.

Dynamic programming over the global histogram of lengths chooses the bucket boundaries with the least padding.
Inside each bucket, documents fill batches of a fixed budget of padded tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from tallyframe.llm.common import stored

BUCKETS = 16
BUDGET = 32768
# Batches of a bucket that are filled together.
CHUNK_BATCHES = 64


@F.arrow_udf(LongType())
def word_tokens(texts: pa.Array) -> pa.Array:
    """Words between ASCII white space and one end mark; null counts as empty."""
    return pa.array([len(t.as_buffer().to_pybytes().split()) + 1 for t in pc.fill_null(texts, "")], pa.int64())


def histogram(lengths: DataFrame) -> DataFrame:
    """A row per length (column ``n_tokens``): the number ``n``, ``total`` and ``longest`` of its documents.

    Different lengths add up, so there are at most as many rows as the square root of twice the tokens.
    """
    n, length = F.count("*").alias("n"), F.col("n_tokens")
    return lengths.groupBy("n_tokens").agg(n).select("n", (F.col("n") * length).alias("total"), length.alias("longest"))


def _cuts(best: np.ndarray, upto_n: np.ndarray, upto_total: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For each row j the first i with the least padding when rows i to j are one bucket behind ``best[i]``.

    These i never fall as j rises, so each is looked for between those of its neighbours of twice the stride.
    """
    n = len(longest)
    cut = np.zeros(n, np.int64)
    stride = 1 << n.bit_length()
    while stride := stride // 2:
        at = np.arange(stride - 1, n, 2 * stride)
        if not len(at):
            continue
        low = np.where(at >= stride, cut[np.maximum(at - stride, 0)], 0)
        high = np.where(at + stride < n, np.minimum(at, cut[np.minimum(at + stride, n - 1)]), at)
        width = high - low + 1
        start = width.cumsum() - width
        i = np.arange(width.sum()) - np.repeat(start - low, width)
        j = np.repeat(at, width)
        through = best[i] + (upto_n[j + 1] - upto_n[i]) * longest[j] - (upto_total[j + 1] - upto_total[i])
        hits = np.flatnonzero(through == np.repeat(np.minimum.reduceat(through, start), width))
        cut[at] = i[hits[np.unique(j[hits], return_index=True)[1]]]
    return cut


def boundaries(rows: list[tuple[int, int, int]], buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most ``buckets`` buckets with the least padding.

    ``rows``: number, total length and longest length of each histogram row. Every bound is the longest length of
    a row; ``best[j]`` is the least padding of the first j rows.
    """
    rows = sorted(rows, key=lambda r: r[2])
    if not rows:
        return []
    number, total, longest = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    n = len(rows)
    upto_n, upto_total = np.concatenate([[0], number.cumsum()]), np.concatenate([[0], total.cumsum()])
    cuts = [np.zeros(n, np.int64)]
    best = np.concatenate([[0], upto_n[1:] * longest - upto_total[1:]])
    while len(cuts) < min(buckets, n) and best[-1]:
        cut = _cuts(best, upto_n, upto_total, longest)
        cuts.append(cut)
        padding = (upto_n[1:] - upto_n[cut]) * longest - (upto_total[1:] - upto_total[cut])
        best = np.concatenate([[0], best[cut] + padding])
    out, j = [], n
    for cut in reversed(cuts):
        out.append(int(longest[j - 1]))
        j = int(cut[j - 1])
        if j == 0:
            break
    return out[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per document: ``id_col``, ``n_tokens``, ``bucket``, ``padded_tokens``, ``batch_id``, ``position``.

    ``tokens`` gives the length of a text (at least 1); without it words and an end mark are counted, so null and
    empty texts have length 1. ``padded_tokens`` is the bound of the bucket. A batch holds as many documents of
    one bucket as its ``budget`` allows, at least one: a document longer than the budget is a batch of its own.
    Documents go to chunks of a bucket by a hash of their id and are numbered within; each chunk has one batch at
    most that isn't full. Repeated rows are packed one by one. An empty table gives an empty result; other columns
    are not read.
    """
    length = word_tokens(F.col(text_col).cast("string")) if tokens is None else tokens
    rows = stored(docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n_tokens")), "lengths")
    bounds = boundaries([tuple(r) for r in histogram(rows).collect()], buckets)
    place = F.array(*map(F.lit, bounds)) if bounds else F.array(F.lit(1))
    placed = rows.withColumn("bucket", F.size(F.filter(place, lambda b: b < F.col("n_tokens"))))
    counts = {r.bucket: r.n for r in placed.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    fits = [max(1, budget // b) for b in bounds] or [1]
    chunks = [max(1, counts.get(i, 0) // (CHUNK_BATCHES * f)) for i, f in enumerate(fits)]

    def of_bucket(values: list[int]) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), F.col("bucket") + 1)

    chunked = placed.withColumn("chunk", F.pmod(F.xxhash64("id"), of_bucket(chunks)))
    order = Window.partitionBy("bucket", "chunk").orderBy(F.xxhash64("id"), "id", "n_tokens")
    numbered = chunked.withColumn("number", F.row_number().over(order) - 1).withColumn("fit", of_bucket(fits))
    return numbered.select(
        F.col("id").alias(id_col),
        "n_tokens",
        "bucket",
        of_bucket(bounds or [1]).alias("padded_tokens"),
        F.concat_ws("-", "bucket", "chunk", F.floor(F.col("number") / F.col("fit"))).alias("batch_id"),
        (F.col("number") % F.col("fit")).cast("int").alias("position"),
    )


def batches(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per batch: ``batch_id``, ``bucket``, ``n_docs``, ``n_tokens``, ``n_padded``, and the ids in order."""
    return packed.groupBy("batch_id", "bucket").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("padded_tokens").alias("n_padded"),
        F.transform(F.array_sort(F.collect_list(F.struct("position", id_col))), lambda p: p[id_col]).alias("ids"),
    )
