"""Grouping of spelling variants by PartEnum signatures.

Words are near when one inserted, deleted or replaced code point turns one into the other. Their letter multisets,
taken as binary vectors over (letter, which occurrence of it), then differ in at most two places: in one if the
lengths differ by one, in two if they are equal. The places are dealt over ``PARTS`` parts. Vectors that differ in
``k`` places agree in all but ``k`` parts, so they share the signature of some choice of ``PARTS - k`` parts; each
word enumerates these choices. One edit also leaves one half of the word as it is, before or behind it. That half
and the two lengths are part of each signature, so even a bucket of anagrams holds little but true neighbours. Words
meet in an equi-join on signatures, and every pair is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

MIN_LENGTH = 5
MIN_COUNT = 3
# Parts for words of equal length (two differing places) and of lengths that differ by one (one place).
PARTS = {2: 4, 1: 2}
# Letters of a run, and one run in so many that loses a code point.
RUN = "[a-zÀ-ÿ]+"
LOSSY = 97
SAME, SHORT, LONG = 0, 1, 2


def lowered(text: str) -> str:
    return text.encode().lower().decode()  # bytes.lower changes A-Z only


def with_losses(run: str, before: int, lossy: int) -> str:
    """``run``, less one code point where its checksum, begun at ``before``, says so."""
    checksum = zlib.crc32(run.encode(), before)
    if not lossy or checksum % lossy:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1 :]


def count_words(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    lossy: int = LOSSY,
) -> DataFrame:
    """``word``, ``n`` of all words with enough letters and occurrences. A task sums up a batch before the shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    find = re.compile(RUN).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc, text in zip(*batch.columns, strict=True):
                if not text.is_valid:
                    continue
                before = zlib.crc32(f"{'' if not doc.is_valid else doc.as_py()}:".encode())
                for run, n in Counter(find(lowered(text.as_py()))).items():
                    if len(run) >= min_length:
                        word = with_losses(run, before, lossy)
                        if len(word) >= min_length:
                            total[word] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _part(letter: str, occurrence: int, parts: int) -> int:
    return xxhash.xxh32_intdigest(f"{letter}{occurrence}", parts) % parts


def _elements(word: str, parts: int) -> list[list[str]]:
    """The places that are set in the word's vector, in order, by part."""
    out: list[list[str]] = [[] for _ in range(parts)]
    for letter, n in sorted(Counter(word).items()):
        for i in range(n):
            out[_part(letter, i, parts)].append(f"{letter}{i}")
    return out


def _chosen(word: str, places: int, parts: int) -> list[str]:
    """One string per choice of ``parts - places`` parts."""
    by_part = ["".join(p) for p in _elements(word, parts)]
    choices = enumerate(combinations(range(parts), parts - places))
    return [f"{i}:{'|'.join(by_part[p] for p in chosen)}" for i, chosen in choices]


def signatures(word: str) -> list[tuple[int, int]]:
    """``(role, signature)``: words of equal length meet as SAME, others as SHORT and LONG of their pair of lengths."""
    out, n = [], len(word)
    for role, short in ((SAME, n), (SHORT, n), (LONG, n - 1)):
        half = short // 2
        kept = (f"<{word[:half]}", f">{word[n - (short - half) :]}")
        kind = "s" if role == SAME else "d"
        places = 2 if role == SAME else 1
        for choice in _chosen(word, places, PARTS[places]):
            for part in kept:
                out.append((role, xxhash.xxh64_intdigest(f"{kind}{short}\n{part}\n{choice}") - (1 << 63)))
    return out


def _signed(words: DataFrame) -> DataFrame:
    """``words`` repeated once per signature: ``word``, ``n``, ``role``, ``signature``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out: list[tuple[str, int, int, int]] = []
                for word, n in zip(*(c.to_pylist() for c in batch.slice(start, 1000).columns), strict=True):
                    out.extend((word, n, role, signature) for role, signature in signatures(word))
                kinds = (pa.string(), pa.int64(), pa.int8(), pa.int64())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["word", "n", "role", "signature"])

    return words.select("word", "n").mapInArrow(sign, "word string, n long, role tinyint, signature long")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n``: both directions of every pair at edit distance one, each once."""
    signed = stored(_signed(words), "variant-signatures")
    left, right = signed.alias("l"), signed.alias("r")
    meet = (F.col("l.signature") == F.col("r.signature")) & (
        ((F.col("l.role") == SAME) & (F.col("r.role") == SAME) & (F.col("l.word") < F.col("r.word")))
        | ((F.col("l.role") == SHORT) & (F.col("r.role") == LONG))
    )
    found = left.join(right, meet).where(F.levenshtein("l.word", "r.word", 1) == 1)
    pairs = stored(
        found.select(
            F.col("l.word").alias("a"), F.col("l.n").alias("a_n"), F.col("r.word").alias("b"), F.col("r.n").alias("b_n")
        ).distinct(),
        "variant-pairs",
    )
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for the rows ``word``, ``form``: the end of each chain of forms.

    Every round all pointers jump as far again, so chains of up to 2^k steps take k rounds.
    """
    pointers = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = pointers.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumped = stored(pointers.join(ahead, "root", "left"), "variant-roots")
        if jumped.where("further IS NOT NULL").isEmpty():
            return jumped.select("word", "root")
        pointers = jumped.select("word", F.coalesce("further", "root").alias("root"))


def group_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    lossy: int = LOSSY,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the runs of Latin letters (A-Z in lower case) of all texts; where ``lossy`` divides the CRC-32 of
    ``id:run``, the run loses one code point (0 turns that off). Words of ``min_length`` code points and
    ``min_count`` occurrences count. A word's form is its near word (edit distance one) with the largest count, of
    equal ones the smallest in code point order, if that is at least twice its own count; ``root`` is the last of
    the chain of forms, the word itself if it has none. Each form at least doubles the count, so no chain is a ring.

    Null and empty texts have no words, a null id counts as an empty one, and repeated rows count repeatedly. An
    empty table gives no rows; other columns are not read.
    """
    words = stored(count_words(docs, id_col, text_col, min_length, min_count, lossy), "variant-words")
    best = F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near").alias("form")))
    known = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.when(-F.col("best.least") >= 2 * F.col("n"), F.col("best"))
    known = known.select("word", "n_near", form.alias("best"))
    known = known.select("word", "n_near", "best.form", (-F.col("best.least")).alias("form_n"))
    known = stored(known, "variant-forms")
    ends = roots(known.where("form IS NOT NULL"))
    return (
        words.join(known, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word",
            "form",
            F.coalesce("root", "word").alias("root"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            "form_n",
        )
    )
