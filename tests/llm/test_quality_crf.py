import itertools
import math
import zlib

import numpy as np
import pytest

from tallyframe.llm.quality_crf import _chain_gradient, classify, fit, keep_good, line_features, marginals, train


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        scores, bad, good = rng.normal(0, 2, n).tolist(), 0.7, -0.4
        total, of_line = 0.0, [0.0] * n
        for labels in itertools.product((0, 1), repeat=n):
            weight = sum(s for s, y in zip(scores, labels) if y)
            weight += sum(bad if a == b == 0 else good if a == b == 1 else 0 for a, b in itertools.pairwise(labels))
            total += math.exp(weight)
            for i, y in enumerate(labels):
                of_line[i] += y * math.exp(weight)
        assert marginals(scores, bad, good) == pytest.approx([v / total for v in of_line])
    assert marginals([], 1, 1) == []


def test_gradient_equals_differences():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(9, 3)), np.ones(9)])
    y = rng.integers(0, 2, 9).astype(float)
    chains = [[0, 1, 2, 3, 4], [5, 6, 7], [8]]
    lines = [np.array([c[t] for c in chains if len(c) > t]) for t in range(5)]

    def likelihood(theta):
        out = 0.0
        for c in chains:
            weights = {}
            for labels in itertools.product((0, 1), repeat=len(c)):
                w = sum(x[i] @ theta[:-2] for i, v in zip(c, labels) if v)
                w += sum(theta[-2] if a == b == 0 else theta[-1] if a == b == 1 else 0 for a, b in itertools.pairwise(labels))
                weights[labels] = w
            out += weights[tuple(int(v) for v in y[c])] - math.log(sum(map(math.exp, weights.values())))
        return out / len(chains)

    theta, step = rng.normal(size=6), 1e-5
    want = [(likelihood(theta + d) - likelihood(theta - d)) / (2 * step) for d in np.eye(6) * step]
    assert _chain_gradient(x, y, lines, theta) == pytest.approx(want, abs=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_training_does_not_see_held_out_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) AS binary)) % 5 = 0, 1 - quality, quality) AS quality")
    assert classify(documents, labels).collect() == classify(documents, flipped).collect()


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 0), (2, 0)], [(None, 1), (3, None)], [(i, i % 2) for i in range(9)] * 2])
def test_few_labels_and_hard_texts(spark, hard, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = classify(hard, known).collect()
    assert len(rows) == hard.count()
    by_text = {}
    for r, h in zip(rows, hard.collect()):
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        assert by_text.setdefault(h.text, r.score) == r.score
    assert by_text[None] == by_text[""] == min(by_text.values())
    kept = keep_good(hard, known)
    assert kept.columns == hard.columns and kept.count() == sum(r.predicted for r in rows)


def test_lines():
    features, lengths = line_features("One two.\n\n \nOne two.\nTHREE!! FOUR!!")
    assert lengths.tolist() == [8, 8, 14] and features.shape[0] == 3
    assert line_features(None)[0].shape == (0, features.shape[1])
    assert len(line_features("a\n" * 50)[1]) == 50
    assert fit([]).score("some text") == 0.5


def test_training_reads_long_documents_to_their_end(spark):
    clean = "These are the plain words of a line that reads well.\n"
    rows = [(i, clean * (30 + i % 7) if i % 2 else clean * 320 + "BUY NOW!!! $$$ 999\n" * 100) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    # The junk begins after 320 lines: without it both kinds would read alike.
    cut = docs.selectExpr("doc_id", "substring_index(text, '\\n', 300) AS text")
    read, prefix = train(docs, labels), train(cut, labels)
    assert (read.mean != prefix.mean).any()
    assert read.score(rows[0][1]) < 0.5 < read.score(rows[1][1])
