"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised to lower-case words. The words of the benchmark are numbered, every window of an item is a
pattern of the automaton over these numbers, and each document is scanned once, as a string of numbers. Normalising
keeps byte positions, so a hit is mapped back to the original text.

A task holds the automaton, one batch as it came, and the words of one document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyframe.llm.common import fresh, stored

WINDOW = 13
# Windows of one automaton, in bytes of text; an automaton takes some 30 times as much. A larger benchmark is
# scanned for in one job per block.
BLOCK_BYTES = 4 << 20
HIT = "struct<n_words:bigint,n_hit:bigint,items:array<{kind}>,spans:array<struct<from:int,upto:int>>,contaminated:boolean>"
FOUND = "struct<n_words:bigint,ranges:array<struct<from:int,upto:int>>,items:array<{kind}>>"

# A word byte stays (A-Z in lower case), any other becomes a space. Bytes from 0x80 belong to words.
_KEPT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def normalised(text: str) -> bytes:
    """The words of ``text`` and spaces, as long in bytes as ``text`` itself."""
    return text.encode().translate(_KEPT)


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """The distinct windows of all items with the ids of their items: ``window``, ``ids``."""
    rows = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normalised(text).decode().split(" ")
                words = [w for w in words if w]
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    ids.append(item)
                    windows.append(" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.column(0).type), pa.array(windows, pa.string())], ["id", "window"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(cut, f"id {kind}, window string").groupBy("window").agg(F.collect_set("id").alias("ids"))


def _blocks(windows: DataFrame, block_bytes: int) -> list:
    """Broadcast variables of at most about ``block_bytes`` each, which hold all windows together."""
    spark, windows = windows.sparkSession, stored(windows, "windows")
    weight = windows.agg(F.sum(F.octet_length("window") + 16 * F.size("ids"))).first()[0] or 0
    n = max(1, -(-weight // block_bytes))
    out = []
    for i in range(n):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(n)) == i).collect()
        out.append(spark.sparkContext.broadcast([(r.window, r.ids) for r in rows]))
    return out


class Scanner:
    """Finds all windows in a text: ``ranges`` of word numbers and the ids of the ``items``.

    A word's number is written in digits to the base 64, each place with signs of its own, so that a pattern can't
    match across words and a node of the automaton has few branches.
    """

    def __init__(self, rows: list[tuple[str, list]]) -> None:
        windows = [(window.encode().split(), ids) for window, ids in rows]
        words = sorted({w for window, _ in windows for w in window})
        self.width = next(n for n in range(1, 99) if 64**n >= len(words))
        self.code = {word: self._code(k) for k, word in enumerate(words)}
        self.unknown = "?" * self.width
        self.found = ahocorasick.Automaton()
        for window, ids in windows:
            self.found.add_word("".join([self.code[w] for w in window]), (len(window), ids))
        self.found.make_automaton()

    def _code(self, k: int) -> str:
        return "".join(chr(256 + 64 * place + (k >> 6 * place & 63)) for place in range(self.width))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set]:
        words = normalised(text).split()
        ranges: list[tuple[int, int]] = []
        items: set = set()
        if self.code:
            get, unknown = self.code.get, self.unknown
            # Bound to a name: an iterator of the automaton need not keep its text alive.
            coded = "".join([get(w, unknown) for w in words])
            for end, (length, ids) in self.found.iter(coded):
                last = end // self.width + 1
                ranges.append((last - length, last))
                items.update(ids)
        return len(words), ranges, items


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Ranges of words as code point positions in ``text``."""
    data, at, point, byte = text.encode(), [], 0, 0
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", normalised(text))]
    for place in (p for a, b in ranges for p in (words[a][0], words[b - 1][1])):
        point, byte = point + len(data[byte:place].decode()), place
        at.append(point)
    return [{"from": a, "upto": b} for a, b in zip(at[::2], at[1::2], strict=True)]


def _judged(text: str, n: int, ranges: list[tuple[int, int]], items: set, share: int) -> dict:
    whole = _union(ranges)
    n_hit = sum(b - a for a, b in whole)
    return {
        "n_words": n,
        "n_hit": n_hit,
        "items": sorted((i for i in items if i is not None), key=str),
        "spans": _spans(text, whole) if whole else [],
        "contaminated": n_hit > 0 and share * n_hit >= n,
    }


def _arrow_types(kind: pa.DataType) -> tuple[pa.DataType, pa.DataType]:
    """The Arrow types of ``HIT`` and ``FOUND`` for items with ids of this type."""
    n, ids = ("n_words", pa.int64()), ("items", pa.list_(kind))
    pairs = pa.list_(pa.struct([("from", pa.int32()), ("upto", pa.int32())]))
    hit = pa.struct([n, ("n_hit", pa.int64()), ids, ("spans", pairs), ("contaminated", pa.bool_())])
    return hit, pa.struct([n, ("ranges", pairs), ids])


def _scanning(block: Broadcast, ddl: str, arrow: pa.DataType, made: Callable[..., dict]) -> Callable:
    """A column function over texts: ``made`` of each text and what a scan for ``block`` finds in it."""

    @F.arrow_udf(ddl)
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(block.value)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch)
            yield pa.array([made(t, *scanner.scan(t)) for t in texts], arrow)

    return scanned


def mark(
    docs: DataFrame,
    items: DataFrame,
    name: str,
    id_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    share: int = 20,
) -> DataFrame:
    """``docs`` with a struct ``name``: ``n_words``, ``n_hit``, ``items`` (sorted as strings), ``spans``, ``contaminated``.

    ``spans`` are the hit passages as code point positions in the original text. A text is contaminated when it
    has a hit and at least one word in ``share`` is hit. Item windows go to the executors in blocks of at most
    about ``block_bytes``. With several blocks there is one job for each, which stores the hits of the documents
    that have any; these are then united per document.
    """
    kind = items.schema[id_col].dataType
    blocks = _blocks(item_windows(items, id_col, text_col, window), block_bytes)
    hit_ddl, found_ddl = (d.format(kind=kind.simpleString()) for d in (HIT, FOUND))
    hit_arrow, found_arrow = _arrow_types(to_arrow_type(kind))
    text = F.col(text_col).cast("string")
    if len(blocks) == 1:

        def judged(original: str, n: int, ranges: list, found: set) -> dict:
            return _judged(original, n, ranges, found, share)

        return docs.withColumn(name, _scanning(blocks[0], hit_ddl, hit_arrow, judged)(text))

    row, hits = fresh(docs, "row"), fresh(docs, "hits")
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "texts")

    def found_rows(_: str, n: int, ranges: list, found: set) -> dict:
        pairs = [{"from": a, "upto": b} for a, b in _union(ranges)]
        return {"n_words": n, "ranges": pairs, "items": sorted((i for i in found if i is not None), key=str)}

    found = None
    for block in blocks:
        scan = _scanning(block, found_ddl, found_arrow, found_rows)
        part = docs.select(row, scan(text).alias("found")).where(F.size("found.ranges") > 0)
        part = stored(part.select(row, "found.ranges", "found.items"), "hits")
        found = part if found is None else found.unionByName(part)
    united_hits = (F.flatten(F.collect_list(c)).alias(c) for c in ("ranges", "items"))
    per_row = found.groupBy(row).agg(F.struct(*united_hits).alias(hits))

    @F.arrow_udf(hit_ddl)
    def united(texts: pa.Array, all_hits: pa.Array) -> pa.Array:
        out = []
        for text, hit in zip(texts, all_hits, strict=True):
            text, hit = text.as_py() or "", hit.as_py() or {"ranges": [], "items": []}
            ranges = [(x["from"], x["upto"]) for x in hit["ranges"]]
            out.append(_judged(text, len(normalised(text).split()), ranges, set(hit["items"]), share))
        return pa.array(out, hit_arrow)

    return docs.join(per_row, row, "left").withColumn(name, united(text, F.col(hits))).drop(row, hits)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: ``id_col`` and the fields of ``mark``.

    Words are runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z. An item with fewer
    than ``window`` words is one window; one without words has none. A null text has no words, and neither nulls
    nor empty texts are contaminated. Repeated documents are judged alike, repeated items count once by id,
    items with a null id mark words but are not listed. Empty tables give no hits or no rows; other columns are
    not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = mark(rows, items, "hit", window=window, block_bytes=block_bytes)
    return found.select(F.col("doc").alias(id_col), "hit.*")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that ``decontaminate`` does not mark, with all their columns."""
    name = fresh(docs, "hit")
    marked = mark(docs, items, name, "item_id", text_col, window)
    return marked.where(~F.col(name)["contaminated"]).drop(name)
