"""Substring de-duplication with difference-cover anchors.

A shared window of ``window`` words is found without hashing every window of every text. Anchors, runs of
``window - period + 1`` words, are hashed only at positions whose remainder modulo ``period`` is in a difference
cover. For any two positions some shift below ``period`` moves both to cover positions, so two equal windows
always share an aligned anchor. Only windows that hold a shared anchor are then hashed whole (the extension) and
compared by 96 bits over all documents.

Whole copies of a smaller document are set aside first, as all their windows start in that one. Both comparisons combine within each batch first: of the documents of a batch that share a hash, only the one
with the smallest id is compared further, and the others are settled on the spot. A passage in a third of all
documents thus costs a reducer one row per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from tallyframe.llm.common import stored

WINDOW = 13
PERIOD = 7
# Perfect difference covers; every remainder is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
FIRST, LEADS, SETTLED = 0, 1, 2
HASH = f"CASE WHEN kind = {SETTLED} THEN key ^ xxhash64(id) ELSE key END"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _coefficients(n: int, lane: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([k]), lane) | 1 for k in range(n)], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """The 64-bit hashes of the words between ASCII white space."""
    words = text.encode().split() if text else []
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(words: np.ndarray, starts: np.ndarray, length: int, lane: int) -> np.ndarray:
    """A hash of the ``length`` words from each start."""
    total = np.zeros(len(starts), np.uint64)
    for k, c in enumerate(_coefficients(length, lane)):
        total += words[starts + k] * c
    total ^= total >> np.uint64(32)
    total *= _GOLDEN
    return (total ^ (total >> np.uint64(29))).view(np.int64)


def cover_positions(n: int, length: int, period: int) -> np.ndarray:
    """The cover positions at which a run of ``length`` words begins in a text of ``n`` words."""
    at = np.arange(max(0, n - length + 1))
    return at[np.isin(at % period, COVERS[period])]


def anchors(words: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    length = window - period + 1
    at = cover_positions(len(words), length, period) if len(words) >= window else np.zeros(0, np.int64)
    return at, run_hashes(words, at, length, 1)


def candidate_starts(words: np.ndarray, shared: np.ndarray, window: int, period: int) -> np.ndarray:
    """Starts of the windows that hold a shared anchor within reach of a shift below ``period``."""
    at, hashes = anchors(words, window, period)
    at = at[np.isin(hashes, shared)]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.maximum(at - period + 1, 0), 1)
    np.add.at(edge, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    return starts[starts <= len(words) - window]


def _combined(ids: np.ndarray, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the distinct (hash, check, id), in order of place, and the kind of each.

    FIRST: the smallest id of this hash and check, and the only one. LEADS: the smallest of several. SETTLED: not
    the smallest.
    """
    order = np.lexsort((ids, checks, hashes))
    h, c, d = hashes[order], checks[order], ids[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    new_row = new_key.copy()
    new_row[1:] |= d[1:] != d[:-1]
    order, first = order[new_row], new_key[new_row]
    kind = np.where(first, FIRST, SETTLED).astype(np.int8)
    kind[:-1][first[:-1] & ~first[1:]] = LEADS
    by_place = np.argsort(order)
    return order[by_place], kind[by_place]


def _exchange_rows(rows: DataFrame, per_text: Callable[..., tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows ``key``, ``check``, ``id``, ``kind`` of the hashes that ``per_text`` finds in each row.

    Rows that need a comparison meet by ``key``, the hash. A settled row needs none; its key is mixed with its id,
    so that the copies of a common passage spread evenly. ``HASH`` takes that back. The rows of a document stay
    together, so that an exchange compresses all of a row but its key.
    """
    names = ["key", "check", "id", "kind"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, checks = [], [], []
            for doc, text, *shared in zip(*batch.columns, strict=True):
                h, c = per_text(text.as_py(), *(x.values.to_numpy() for x in shared))
                ids.append(np.full(len(h), doc.as_py(), np.int64))
                hashes.append(h)
                checks.append(c)
            if not ids:
                continue
            d, h, c = np.concatenate(ids), np.concatenate(hashes), np.concatenate(checks)
            order, kind = _combined(d, h, c)
            d, h, c, alone = d[order], h[order], c[order], kind == SETTLED
            mixed = (xxhash.xxh64_intdigest(i.tobytes(), 42) for i in d[alone])
            h[alone] ^= np.fromiter(mixed, np.uint64, int(alone.sum())).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, c, d, kind)], names)

    return rows.mapInArrow(find, "key long, check int, id long, kind tinyint")


def duplicate_starts(
    texts: DataFrame, compared: DataFrame, window: int = WINDOW, period: int = PERIOD
) -> DataFrame:
    """``id``, ``found``: per ``compared`` document the hashes of its windows that also start in one with a smaller id.

    ``texts`` holds them all and maybe others; it is joined as it is, so that its exchange can be shared.
    """

    def anchor_rows(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        hashes = anchors(word_hashes(text), window, period)[1]
        return hashes, np.zeros(len(hashes), np.int32)

    def window_rows(text: str | None, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = word_hashes(text)
        starts = candidate_starts(words, shared, window, period)
        return run_hashes(words, starts, window, 2), run_hashes(words, starts, window, 3).astype(np.int32)

    meeting = Window.partitionBy("key", "check")
    shared = (
        _exchange_rows(compared, anchor_rows)
        .withColumn("n", F.count("*").over(meeting))
        .where(f"kind <> {FIRST} OR n > 1")
        .groupBy("id")
        .agg(F.collect_list(F.expr(HASH)).alias("shared"))
    )
    return (
        _exchange_rows(texts.join(shared, "id").select("id", "_text", "shared"), window_rows)
        .withColumn("low", F.min("id").over(meeting))
        .where(f"kind = {SETTLED} OR low < id")
        .groupBy("id")
        .agg(F.collect_list(F.expr(HASH)).alias("found"))
    )


@F.arrow_udf(BinaryType())
def _words_digest(texts: pa.Array) -> pa.Array:
    words = (t.as_py().encode().split() if t.is_valid else [] for t in texts)
    return pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())


def copies_of_smaller(texts: DataFrame) -> DataFrame:
    """``id``: the documents of which every row has, as a whole, the words of a document with a smaller id."""
    digests = stored(texts.select("id", _words_digest("_text").alias("digest")), "digests")
    first = digests.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    first = stored(first.where("first < last").select("digest", "first"), "first")
    copied = F.every(F.coalesce(F.expr("id > first"), F.lit(False)))
    ids = digests.join(first, "digest", "left").groupBy("id").agg(copied.alias("copy"))
    return stored(ids.where("copy").select("id"), "copies")


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    period: int = PERIOD,
) -> DataFrame:
    """One row per input row: ``id_col``, ``n_words``, ``n_removed``, ``kept_text``.

    A window is ``window`` consecutive words (what stands between ASCII white space, unchanged) of one document.
    Every word is removed that lies in a window whose words also start in a document with a smaller id; the
    windows are judged on the input. ``kept_text`` joins the other words with one space. Ids are whole numbers.
    Null and empty texts have no words. Rows with a null id are compared with nothing and keep all words. Rows
    that repeat an id count as one document. An empty table gives an empty result; other columns are not read.
    """
    if period not in COVERS or window < period:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most the window")
    # A new name for the text as well: Spark drops an alias to the old one on one side of the plan only, and then no
    # longer sees that the same exchange of the texts by id serves the extension and the cut.
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"))
    texts = rows.where("id IS NOT NULL")
    copies = copies_of_smaller(texts).select("id", F.lit(True).alias("copy"))
    compared = texts.join(copies, "id", "left").where("copy IS NULL").select("id", "_text")
    found = duplicate_starts(texts, compared, window, period)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, repeated, copy in zip(batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
                words = (text or "").encode().split()
                keep = np.full(len(words), not copy.as_py() or len(words) < window)
                if repeated.is_valid:
                    hashes = word_hashes(text)
                    starts = np.arange(max(0, len(words) - window + 1))
                    starts = starts[np.isin(run_hashes(hashes, starts, window, 2), repeated.values.to_numpy())]
                    for k in range(window):
                        keep[starts + k] = False
                n_words.append(len(words))
                n_removed.append(len(words) - int(keep.sum()))
                kept.append(b" ".join(words if keep.all() else compress(words, keep.tolist())))
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(kept, pa.binary()).cast(pa.string())], names)

    names = ["id", "n_words", "n_removed", "kept_text"]
    with_id = texts.join(found, "id", "left").join(copies, "id", "left").select(
        "id", "_text", "found", F.coalesce("copy", F.lit(False)).alias("copy")
    )
    without = rows.where("id IS NULL").select(
        "id", "_text", F.lit(None).cast("array<bigint>").alias("found"), F.lit(False).alias("copy")
    )
    out = with_id.unionByName(without).mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id_col)

