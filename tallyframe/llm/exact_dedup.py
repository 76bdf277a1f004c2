"""Exact de-duplication that stands groups of copies of any size.

Copies meet in three steps, each of which compares whole texts and not only digests: within the task that
read them (the map-side half of the first aggregation), then per salt (a task number modulo ``salts``), then
globally. A text that a third of all rows share therefore reaches a reducer as one row per task of a salt,
and the last step as one row per salt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tallyframe.llm.common import fresh, same, stored

SALTS = 32


def _fold(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(pc.fill_null(texts, ""))


@F.arrow_udf(BinaryType())
def content(texts: pa.Array) -> pa.Array:
    """The whole text with A-Z in lower case, losslessly compressed; null counts as empty.

    Two texts are equal exactly if their compressed forms are, and these are half as large to move.
    """
    return pa.array([pa.compress(t.as_buffer(), codec="zstd", asbytes=True) for t in _fold(texts)], pa.binary())


@F.arrow_udf(StringType())
def folded_sha256(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in _fold(texts)], pa.string())


def _winners(rows: DataFrame, salts: int) -> DataFrame:
    """One row per digest and text: the largest id and the number of rows."""
    best = [F.max("id").alias("keep_id"), F.sum("n").alias("group_size")]
    per_salt = (
        rows.select("id", "digest", "content", F.lit(1).cast("long").alias("n"))
        .withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.max("id").alias("id"), F.sum("n").alias("n"))
    )
    # Placed by digest alone, so that the count of texts per digest needs no further exchange.
    return per_salt.repartition("digest").groupBy("digest", "content").agg(*best)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[str], Column] = folded_sha256,
) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z. The row with the largest id stays. Null
    and empty texts are one group. A null id is smaller than any other; a group of null ids has a null
    ``keep_id`` and is kept. Rows that repeat both id and text count in ``group_size`` and share their fate.
    An empty table gives an empty result. Other columns of ``docs`` are not read. ``digest`` only routes:
    texts with one digest are told apart by content.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    winners = _winners(rows.select("id", digest("text").alias("digest"), content("text").alias("content")), salts)
    per_digest = stored(
        winners.groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")
        ),
        "digests",
    )
    marked = rows.select("id", digest("text").alias("digest"))
    result = marked.join(per_digest.where("texts = 1"), "digest").select("id", "keep_id", "group_size", "digest")
    clashes = per_digest.where("texts > 1").select("digest")
    if not clashes.isEmpty():
        # Different texts with one digest: these rows are joined by content.
        clashing = rows.select("id", digest("text").alias("digest"), content("text").alias("content")).join(
            clashes, "digest", "left_semi"
        )
        groups = stored(_winners(clashing, salts), "clashes")
        result = result.unionByName(
            clashing.join(groups, ["digest", "content"]).select("id", "keep_id", "group_size", "digest")
        )
    return result.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns.

    Of rows that repeat both id and text one stays.
    """
    kept_id, digest = fresh(docs, "kept_id"), fresh(docs, "digest")
    verdict = exact_dedup(docs, id_col, text_col, salts).select(
        F.col(id_col).alias(kept_id), F.col("text_sha256").alias(digest), F.col("kept").alias("_stays")
    )
    # Stored before it is grouped: a grouping in the stage of a join keeps Spark from splitting a hot digest there.
    verdict = stored(verdict, "rows").groupBy(kept_id, digest)
    verdict = stored(verdict.agg(F.max("_stays").alias("_stays"), F.count("*").alias("_rows")), "verdict")
    marked = docs.withColumns({kept_id: F.col(id_col), digest: folded_sha256(F.col(text_col).cast("string"))})
    dropped = verdict.where("NOT _stays").select(kept_id, digest)
    rest = marked.join(dropped, same(marked, dropped, [kept_id, digest]), "left_anti")
    if not verdict.where("_stays AND _rows > 1").isEmpty():
        rest = rest.dropDuplicates([kept_id, digest])
    return rest.drop(kept_id, digest)
