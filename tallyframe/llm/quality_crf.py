"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. A line is described by shares of character classes, repetition and common words, its
own and those of its neighbours; two transition weights tie neighbouring labels. Forward-backward gives the
probability of each line to be good, and the length-weighted mean of these is the quality of the document, which
a logistic curve turns into a score.

Training uses a bounded sample of labelled documents. Labels are known per document only: the lines of a good
document are good, those of a bad one are bad unless they look as good as the lines of good ones do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh
from tallyframe.llm.html_extract import STOP_WORDS

# Bound of the training sample.
MAX_DOCS = 6000
THRESHOLD = 0.3
FOLDS = 5

# Classes of bytes: upper and lower case, digit, space, exclamation mark, common punctuation, other sign, non-ASCII.
_CLASS = bytes(
    ord(
        "U" if 0x41 <= b <= 0x5A else
        "L" if 0x61 <= b <= 0x7A else
        "D" if 0x30 <= b <= 0x39 else
        "W" if b in b" \t\n\r\x0b\x0c" else
        "E" if b == 0x21 else
        "P" if b in b".,;:?'\"()-" else
        "H" if b >= 0x80 else
        "S"
    )
    for b in range(256)
)
BASE = (
    "upper digits signs marks signed_words shouting doubled stop_words distinct repeated word_length length ends short"
).split()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per line that isn't blank, and the lengths of these lines."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        words = line.split()
        if not words:
            continue
        n = len(words)
        kinds = line.encode().strip().translate(_CLASS)
        upper, lower, signs = kinds.count(b"U"), kinds.count(b"L"), kinds.count(b"S")
        solid = max(1, len(kinds) - kinds.count(b"W"))
        rows.append(
            (
                upper / (upper + lower + 1),
                kinds.count(b"D") / solid,
                signs / solid,
                kinds.count(b"P") / solid,
                (kinds.count(b"SW") + kinds.endswith(b"S")) / n,
                (kinds.count(b"EW") + kinds.endswith(b"E")) / n,
                float(line in seen),
                sum(map(STOP_WORDS.__contains__, words)) / n,
                len(set(words)) / n,
                sum(map(eq, words, words[1:])) / n,
                min(solid / n, 40) / 10,
                np.log1p(len(line)) / 5,
                float(kinds.endswith((b"P", b"E"))),
                float(n < 4),
            )
        )
        seen.add(line)
        lengths.append(len(line))
    base = np.array(rows, np.float64).reshape(len(rows), len(BASE))
    edge = np.zeros((1, len(BASE)))
    before = np.concatenate([edge, base])[:-1] if rows else base
    after = np.concatenate([base, edge])[1:] if rows else base
    ends = np.zeros((len(rows), 2))
    if rows:
        ends[0, 0] = ends[-1, 1] = 1
    return np.hstack([base, before, after, ends]), np.array(lengths, np.float64)


@dataclass(frozen=True)
class Model:
    """Standardised line weights, the weights of staying bad and staying good, and the logistic curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    stay: tuple[float, float]
    curve: tuple[float, float]

    def line_scores(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale @ self.weights + self.bias, -30, 30)

    def quality(self, features: np.ndarray, lengths: np.ndarray) -> float:
        """Length-weighted mean of the lines' probabilities to be good; 0 without lines."""
        if not len(lengths):
            return 0.0
        good = marginals(self.line_scores(features).tolist(), *self.stay)
        return float(np.dot(good, lengths) / lengths.sum())

    def score(self, text: str | None) -> float:
        return curve(self.quality(*line_features(text)), *self.curve)


def curve(quality: float, slope: float, shift: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(slope * _logit(quality) + shift, -50, 50))))


def _logit(q):
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def marginals(scores: list[float], stay_bad: float, stay_good: float) -> list[float]:
    """Forward-backward over two states: the probability of each line to be good.

    ``scores`` are the log odds of good by the line alone; changing sides weighs 0.
    """
    good = [2.718281828459045**s for s in scores]
    bb, gg = 2.718281828459045**stay_bad, 2.718281828459045**stay_good
    forward, b, g = [], 0.5, 0.5
    for i, e in enumerate(good):
        b, g = (b * bb + g, (b + g * gg) * e) if i else (1.0, e)
        total = b + g
        b, g = b / total, g / total
        forward.append((b, g))
    out, b, g = [0.0] * len(good), 1.0, 1.0
    for i in range(len(good) - 1, -1, -1):
        fb, fg = forward[i]
        out[i] = fg * g / (fb * b + fg * g)
        e = good[i]
        b, g = b * bb + g * e, b + g * gg * e
        total = b + g
        b, g = b / total, g / total
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the last column of ``x`` is not held small."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + hold * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _chain_gradient(x: np.ndarray, y: np.ndarray, lines: list[np.ndarray], theta: np.ndarray) -> np.ndarray:
    """Gradient of the mean log-likelihood of the labelled chains.

    ``lines[t]`` has the rows of the line t of all documents that have one, longer documents first, so that the
    documents of a step are the first ones of the step before.
    """
    e = np.exp(np.clip(x @ theta[:-2], -30, 30))
    bb, gg = np.exp(theta[-2]), np.exp(theta[-1])
    first = e[lines[0]]
    forward = [np.stack([1 / (1 + first), first / (1 + first)])]
    for at in lines[1:]:
        b, g = forward[-1][:, : len(at)]
        now = np.stack([b * bb + g, (b + g * gg) * e[at]])
        forward.append(now / now.sum(0))
    good, both_bad, both_good = np.zeros(len(x)), 0.0, 0.0
    back = np.ones((2, 0))
    for t in range(len(lines) - 1, -1, -1):
        at = lines[t]
        # Documents whose last line this is begin here.
        back = np.hstack([back, np.ones((2, len(at) - back.shape[1]))])
        here = forward[t] * back
        good[at] = here[1] / here.sum(0)
        if t == 0:
            break
        b, g = back[0], back[1] * e[at]
        fb, fg = forward[t - 1][:, : len(at)]
        joint = np.stack([fb * bb * b, fb * g, fg * b, fg * gg * g])
        joint /= joint.sum(0)
        both_bad += joint[0].sum()
        both_good += joint[3].sum()
        new = np.stack([b * bb + g, b + g * gg])
        back = new / new.sum(0)
    pairs = [(y[a[: len(b)]], y[b]) for a, b in zip(lines, lines[1:], strict=False)]
    of_stay = [
        sum(float(((1 - a) * (1 - b)).sum()) for a, b in pairs) - both_bad,
        sum(float((a * b).sum()) for a, b in pairs) - both_good,
    ]
    return np.append(x.T @ (y - good), of_stay) / len(lines[0])


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], ridge: float = 1.0, rounds: int = 100) -> Model:
    """The model of (features, line lengths, label) of documents; documents without lines are left out."""
    samples = [s for s in samples if len(s[1])]
    width = line_features("x")[0].shape[1]
    labels = np.array([s[2] for s in samples], float)
    if not samples or labels.min() == labels.max():
        # Nothing to tell apart: every document gets the only label seen, or an even score.
        always = 0.0 if not samples else 5.0 if labels[0] else -5.0
        return Model(np.zeros(width), np.ones(width), np.zeros(width), always, (0.0, 0.0), (1.0, 0.0))
    features = np.concatenate([s[0] for s in samples])
    counts = np.array([len(s[1]) for s in samples])
    doc = np.repeat(np.arange(len(samples)), counts)
    share = np.concatenate([s[1] / s[1].sum() for s in samples])
    mean, scale = features.mean(0), np.maximum(features.std(0), 1e-3)
    x = np.column_stack([(features - mean) / scale, np.ones(len(features))])

    of_doc = labels[doc]
    even = np.where(of_doc == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    alone = _logistic(x, of_doc, share * even, ridge)
    looks_good = x @ alone > 1.5
    worst = np.zeros(len(x), bool)
    at = np.concatenate([[0], np.cumsum(counts)])
    alone_score = x @ alone
    worst[[a + int(np.argmin(alone_score[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]] = True
    y = np.where((of_doc == 0) & looks_good & ~worst, 1.0, of_doc)

    by_length = np.argsort(-counts, kind="stable")
    lines = [at[:-1][by_length[: int((counts > t).sum())]] + t for t in range(counts.max())]
    theta = np.append(alone, [0.5, 0.5])
    step, spread = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        slope = _chain_gradient(x, y, lines, theta) - ridge / len(samples) * np.append(theta[:-3], [0, 0, 0])
        step = 0.9 * step + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        theta += 0.05 * (step / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
    stay = (float(np.clip(theta[-2], -4, 4)), float(np.clip(theta[-1], -4, 4)))
    raw = Model(mean, scale, theta[:-3], float(theta[-3]), stay, (1.0, 0.0))
    quality = np.array([raw.quality(f, n) for f, n, _ in samples])
    slope, shift = _logistic(np.column_stack([_logit(quality), np.ones(len(quality))]), labels, np.ones(len(labels)), 0.1)
    return Model(mean, scale, raw.weights, raw.bias, stay, (float(max(slope, 1e-3)), float(shift)))


def held_out(id_col: str) -> Column:
    """True for the ids that training never sees; a null id is one of them."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_docs: int = MAX_DOCS,
) -> Model:
    """The model of at most ``max_docs`` labelled documents that aren't held out, chosen by a hash of their id.

    A document with several labels counts as the worst of them. All lines of a document are used.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out("id")).groupBy("id").agg(F.min("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_docs).collect()
    if not chosen:
        return fit([])
    kind = known.schema["id"].dataType.simpleString()
    sample = spark.createDataFrame([tuple(r) for r in chosen], f"id {kind}, label int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_features(t.as_py()) for t in batch.column(2)]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([f.astype(np.float32).tobytes() for f, _ in made], pa.binary()),
                pa.array([n.tobytes() for _, n in made], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "features", "lengths"])

    # At most ``max_docs`` ids are broadcast.
    rows = texts.join(F.broadcast(sample), "id").select("id", "label", "text")
    rows = rows.mapInArrow(measure, f"id {kind}, label int, features binary, lengths binary").collect()
    width = line_features("x")[0].shape[1]
    rows.sort(key=lambda r: (r.id, r.lengths, r.features))
    return fit(
        [
            (np.frombuffer(r.features, np.float32).reshape(-1, width).astype(float), np.frombuffer(r.lengths), int(r.label))
            for r in rows
        ]
    )


def scores(model: Model, text: Column | str) -> Column:
    """The score of a text: 0 to 1, higher for better; texts without words get the lowest."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t.as_py()) for t in texts], pa.float64())

    return scored(F.col(text).cast("string") if isinstance(text, str) else text)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    **training: int,
) -> DataFrame:
    """One row per document: ``id_col``, ``held_out``, ``score``, ``predicted``.

    Scores come from whole texts alone. Null, empty and blank texts have no lines and get the lowest score. Without
    usable labels every text with lines gets 0.5; with labels of one kind only, that kind. Repeated rows get equal
    scores; an empty table gives an empty result; other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, **training)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), scores(model, text_col).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    model = train(docs, labels, text_col=text_col)
    name = fresh(docs, "score")
    marked = docs.withColumn(name, scores(model, text_col))
    return marked.where(F.col(name) >= threshold).drop(name)
