"""Subword lattice language model: a text's probability, summed over all its segmentations into pieces.

The pieces and their first scores come from an existing vocabulary file, which is read and never trained. A text is its
tokens, words between ASCII white space with A-Z in lower case, each with the word mark before it, and an end. As no
piece goes beyond a word, the lattice of a text falls into those of its words. A forward recursion in log space adds
up all paths through the lattice of a word; a character that the vocabulary lacks has its UTF-8 bytes as path.
Re-estimation by expected counts (forward and backward over the lattices of all distinct training words, weighted by
their counts) fits the weights of the pieces to the corpus.

Texts are cut into chunks of bounded size: their distinct words, and each text as a bag of places in that list.
Counts and word scores are joined to the words of a chunk, not to tokens, and return to the chunk as one array, so a
frequent word costs one row per chunk, and texts are read once and never moved.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain, pairwise
from math import exp, log, log10

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import stored

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
END = "</s>"
# Code points of text in one chunk, unless one text alone has more.
CHUNK_CHARS = 1 << 22
ROUNDS = 2
FOLDS, HELD_OUT = 5, 1
# The vocabulary's own weights count as so many pieces seen, so that none becomes impossible.
PRIOR = 100.0
WORDS = re.compile("[^\x20\x09-\x0d]+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.encode().lower().decode()) if text else []  # bytes.lower changes A-Z only


def held_out(doc_id: object) -> bool:
    """Whether the row is kept out of the training; a row without id is trained on."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


BYTES = [f"<0x{b:02X}>" for b in range(256)]
# Names that no text matches.
SPECIAL = {END, *BYTES}


def _as_logs(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {p: log(w / total) for p, w in weights.items()}


def read_pieces(path: str) -> dict[str, float]:
    """Log probabilities of the pieces, bytes and end of a model file; together they are one.

    Scores that are ranks of merges become weights one over rank.
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            scores[model.id_to_piece(i)] = model.get_score(i)
    scores = {p: s for p, s in scores.items() if MARK not in p[1:] and p not in SPECIAL}
    ranks = all(s == int(s) for s in scores.values())
    weights = {p: 1 / (2 - s) if ranks else exp(s) for p, s in scores.items()}
    weights.setdefault(MARK, min(weights.values()))
    return _as_logs(weights | dict.fromkeys(BYTES, min(weights.values())) | {END: max(weights.values())})


def refitted(prior: dict[str, float], counts: dict[str, float], strength: float = PRIOR) -> dict[str, float]:
    """Log probabilities from expected counts, on top of ``strength`` counts that follow the vocabulary's weights."""
    return _as_logs({p: counts.get(p, 0.0) + strength * exp(w) for p, w in prior.items()})


class Lattice:
    """All segmentations of words into pieces, many words at a time."""

    def __init__(self, pieces: dict[str, float]) -> None:
        self.names = list(pieces)
        self.weight = np.array(list(pieces.values()))
        self.length = np.array([len(p) for p in self.names])
        self.byte = self.names.index(BYTES[0])
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, piece in enumerate(self.names):
            if piece not in SPECIAL:
                self.found.add_word(piece, i)
        self.found.make_automaton()

    def _arcs(self, words: list[str]) -> dict[str, np.ndarray]:
        """The arcs of the lattices of ``words``: nodes ``start`` and ``end``, ``weight``, ``piece``, ``word``.

        A character that is no piece gets an arc of its bytes, whose ``piece`` is -1. Nodes number the places
        before, between and after the characters of a word, word after word.
        """
        text = "".join([MARK + w for w in words])
        sizes = np.array([len(w) + 1 for w in words])
        at = np.repeat(np.arange(len(words)), sizes)
        ends, piece = np.fromiter(chain.from_iterable(self.found.iter(text)), np.int64).reshape(-1, 2).T
        starts = ends + 1 - self.length[piece]
        alone = np.ones(len(text), bool)
        alone[ends[starts == ends]] = False
        missing = np.flatnonzero(alone)
        by_bytes = [sum(self.weight[self.byte + b] for b in text[i].encode()) for i in missing]
        starts, ends = np.concatenate([starts, missing]), np.concatenate([ends, missing])
        word = at[ends]
        return {
            "start": starts + word,
            "end": ends + 1 + word,
            "weight": np.concatenate([self.weight[piece], by_bytes]),
            "piece": np.concatenate([piece, np.full(len(missing), -1)]),
            "word": word,
            "first": np.cumsum(sizes + 1) - sizes - 1,
            "last": np.cumsum(sizes + 1) - 1,
            "bytes": np.frombuffer("".join([text[i] for i in missing]).encode(), np.uint8),
            "byte_arc": np.repeat(len(piece) + np.arange(len(missing)), [len(text[i].encode()) for i in missing]),
        }

    @staticmethod
    def _summed(arcs: dict[str, np.ndarray], source: str, target: str, known: np.ndarray) -> np.ndarray:
        """The log of the summed weights of all paths between each node and the ``known`` end of its word."""
        logs = np.full(arcs["last"][-1] + 1, -np.inf)
        logs[known] = 0.0
        step = np.abs(arcs[target] - known[arcs["word"]])
        order = np.lexsort((arcs[target], step))
        origin, node, weight = arcs[source][order], arcs[target][order], arcs["weight"][order]
        first = np.flatnonzero(np.diff(node, prepend=-1))
        rounds = np.searchsorted(first, np.flatnonzero(np.diff(step[order], prepend=-1)))
        for a, b in pairwise([*rounds.tolist(), len(first)]):
            low, high = first[a], first[b] if b < len(first) else len(node)
            paths = logs[origin[low:high]] + weight[low:high]
            logs[node[first[a:b]]] = np.logaddexp.reduceat(paths, first[a:b] - low)
        return logs

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """The natural log of the probability of each word, over all its segmentations."""
        arcs = self._arcs(words)
        return self._summed(arcs, "start", "end", arcs["first"])[arcs["last"]]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """The expected counts of all pieces in ``times`` occurrences of each word."""
        arcs = self._arcs(words)
        ahead = self._summed(arcs, "start", "end", arcs["first"])
        behind = self._summed(arcs, "end", "start", arcs["last"])
        whole = ahead[arcs["last"]][arcs["word"]]
        share = times[arcs["word"]] * np.exp(ahead[arcs["start"]] + arcs["weight"] + behind[arcs["end"]] - whole)
        plain = arcs["piece"] >= 0
        counts = np.bincount(arcs["piece"][plain], share[plain], len(self.names))
        counts[self.byte : self.byte + 256] += np.bincount(arcs["bytes"], share[arcs["byte_arc"]], 256)
        return counts


def _groups(words: list[str], size: int = 1 << 18) -> Iterator[slice]:
    """Slices of ``words`` of about ``size`` code points."""
    first = total = 0
    for i, word in enumerate(words):
        total += len(word) + 1
        if total >= size:
            yield slice(first, i + 1)
            first, total = i + 1, 0
    if first < len(words):
        yield slice(first, len(words))


def packed(bags: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Sparse rows (places in ascending order, counts) in compressed form."""
    sizes = np.array([len(places) for places, _ in bags], np.uint32)
    steps = [np.diff(places, prepend=0).astype(np.uint32) for places, _ in bags]
    counts = [c.astype(np.uint32) for _, c in bags]
    plain = b"".join(x.tobytes() for x in (sizes, *steps, *counts))
    # Bytes of equal weight side by side compress better.
    turned = np.frombuffer(plain, np.uint8).reshape(-1, 4).T.tobytes()
    return pa.compress(turned, codec="zstd", asbytes=True)


def unpacked(data: bytes, rows: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sizes`` of the rows, and their ``places`` and ``counts`` one after the other; ``size`` pairs in all."""
    turned = pa.decompress(data, 4 * (rows + 2 * size), codec="zstd", asbytes=True)
    plain = np.frombuffer(np.frombuffer(turned, np.uint8).reshape(4, -1).T.tobytes(), np.uint32)
    sizes, steps, counts = plain[:rows].astype(np.int64), plain[rows : rows + size], plain[rows + size :]
    ends = np.cumsum(sizes)
    running = np.cumsum(steps, dtype=np.int64)
    before = np.concatenate([[0], running])[ends - sizes]
    return sizes, running - np.repeat(before, sizes), counts


def _bag(counted: Counter, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    places = np.fromiter((place.setdefault(w, len(place)) for w in counted), np.int64, len(counted))
    counts = np.fromiter(counted.values(), np.int64, len(counted))
    order = np.argsort(places)
    return places[order], counts[order]


def _chunked(docs: DataFrame, id_col: str, text_col: str, chunk_chars: int) -> DataFrame:
    """Chunks of whole rows: ``chunk``, ``ids``, their ``bags`` of words by place, with ``size`` pairs in all; the
    distinct ``words`` and how often each stands in ``training`` rows, and the number of these."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (
        f"chunk long, ids array<{id_type}>, bags binary, size long, words array<string>, training array<bigint>, "
        "training_docs long"
    )

    def made(number: int, ids: list, bags: list, place: dict[str, int], id_arrow: pa.DataType) -> pa.RecordBatch:
        training = np.zeros(len(place), np.int64)
        trained = [bag for i, bag in zip(ids, bags, strict=True) if not held_out(i)]
        for places, counts in trained:
            training[places] += counts
        columns = [
            pa.array([number], pa.int64()),
            pa.array([ids], pa.list_(id_arrow)),
            pa.array([packed(bags)], pa.binary()),
            pa.array([sum(len(p) for p, _ in bags)], pa.int64()),
            pa.array([list(place)], pa.list_(pa.string())),
            pa.array([training], pa.list_(pa.int64())),
            pa.array([len(trained)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size = TaskContext.get().partitionId() << 33, 0
        ids, bags, place = [], [], {}
        for batch in batches:
            for doc, text in zip(*batch.columns, strict=True):
                text = text.as_py()
                ids.append(doc.as_py())
                bags.append(_bag(Counter(words_of(text)), place))
                size += len(text or "")
                if size >= chunk_chars:
                    yield made(number, ids, bags, place, batch.column(0).type)
                    number, size = number + 1, 0
                    ids, bags, place = [], [], {}
            kind = batch.column(0).type
        if ids:
            yield made(number, ids, bags, place, kind)

    return stored(rows.mapInArrow(chunks, schema), "lm-chunks", "zstd")


def _per_word(words: DataFrame, pieces: Broadcast, work: Callable, schema: str) -> DataFrame:
    """``work(lattice, batch)`` over the batches of ``words``, with one lattice per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(Lattice(pieces.value), batches)

    return words.mapInArrow(run, schema)


def _expected_counts(lattice: Lattice, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(lattice.names))
    for batch in batches:
        words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        for part in _groups(words):
            counts += lattice.expected(words[part], times[part])
    yield pa.RecordBatch.from_arrays([pa.array(lattice.names), pa.array(counts)], ["piece", "share"])


def _word_scores(lattice: Lattice, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        logs = [lattice.log_probabilities(words[part]) for part in _groups(words)]
        logp = np.concatenate([np.zeros(0), *logs]) / log(10)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logp)], ["word", "c", "logp"])


def train(words: DataFrame, docs: int, prior: dict[str, float], rounds: int = ROUNDS) -> dict[str, float]:
    """The pieces fitted to the training words (``word``, ``c``). One number per piece reaches the driver."""
    pieces = prior
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(pieces)
        seen = words.where("c > 0").select("word", "c")
        shares = _per_word(seen, shared, _expected_counts, "piece string, share double").groupBy("piece")
        counts = {r.piece: r.share for r in shares.agg(F.sum("share").alias("share")).collect()}
        pieces = refitted(prior, counts | {END: float(docs)})
    return pieces


def score(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = ROUNDS,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """One row per input row: ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are words and one end. Rows whose CRC-32 of the id as text leaves 1 modulo 5 are held out of all counts
    and of the training. ``base_score`` is the smoothed unigram log10 probability of the tokens, ``score`` the log10
    probability of the words and the end under the lattice model, summed over all segmentations. White space does not
    count. ``vocabulary`` is a model file that the driver reads; its pieces are broadcast, at most some megabytes.

    Null and empty texts consist of the end. Rows without id are trained on, repeated rows count repeatedly, and a
    word of any length takes time in proportion. With no training row N and the counts are 0 and the pieces keep
    their first weights. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    chunks = _chunked(docs, id_col, text_col, chunk_chars)
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "training"))).select(
        "chunk", "pos", F.col("col.words").alias("word"), F.col("col.training").alias("c")
    )
    words = stored(places.groupBy("word").agg(F.sum("c").alias("c")), "lm-words", "zstd")
    training_docs = chunks.agg(F.sum("training_docs")).first()[0] or 0
    sums = words.where("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (sums.n or 0) + training_docs, sums.v + (training_docs > 0)
    pieces = train(words, training_docs, read_pieces(vocabulary), rounds if n else 0)
    shared = spark.sparkContext.broadcast(pieces)
    scored = stored(_per_word(words, shared, _word_scores, "word string, c long, logp double"), "lm-scores", "zstd")
    back = places.select("chunk", "pos", "word").join(scored, "word").groupBy("chunk")
    back = back.agg(F.sort_array(F.collect_list(F.struct("pos", "c", "logp"))).alias("known"))
    joined = chunks.select("chunk", "ids", "bags", "size").join(back, "chunk", "left").select(
        "ids", "bags", "size", F.col("known.c").alias("c"), F.col("known.logp").alias("logp")
    )
    whole = n + 0.5 * (v + 1)
    end_base, end_score = log10((training_docs + 0.5) / whole), pieces[END] / log(10)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, bags, size, c, logp in zip(*batch.columns, strict=True):
                docs = ids.as_py()
                sizes, places, times = unpacked(bags.as_py(), len(docs), size.as_py())
                seen = c.values.to_numpy() if c.is_valid else np.zeros(0, np.int64)
                logs = logp.values.to_numpy() if logp.is_valid else np.zeros(0)
                base = np.log10((seen + 0.5) / whole)
                row = np.repeat(np.arange(len(docs)), sizes)

                def total(values: np.ndarray, row: np.ndarray = row, times: np.ndarray = times, n: int = len(docs)):
                    return np.bincount(row, values * times, n)

                columns = [
                    ids.values,
                    pa.array([held_out(i) for i in docs]),
                    pa.array((total(np.ones(len(row))) + 1).astype(np.int64)),
                    pa.array((total(seen[places] > 0) + (training_docs > 0)).astype(np.int64)),
                    pa.array(total(base[places]) + end_base),
                    pa.array(total(logs[places]) + end_score),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    judged = joined.mapInArrow(
        judge, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return judged.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
