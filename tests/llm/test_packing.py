import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.packing import batches, boundaries, histogram, pack


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= n) - n for n in lengths)


@pytest.mark.parametrize("seed", range(30))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))]
    distinct, k = sorted(set(lengths)), rng.randrange(1, 5)
    rows = [(c, c * n, n) for n, c in Counter(lengths).items()]
    found = boundaries(rows, k)
    choices = (c for n in range(1, k + 1) for c in itertools.combinations(distinct, min(n, len(distinct))) if c[-1] == distinct[-1])
    assert len(found) <= k and found[-1] == distinct[-1]
    assert padding(lengths, found) == min(padding(lengths, c) for c in choices)
    assert boundaries([], k) == []


def test_histogram_has_every_length(spark):
    lengths = spark.range(1, 3000).selectExpr("id * id % 1000 AS n_tokens")
    rows = {r.longest: (r.n, r.total) for r in histogram(lengths).collect()}
    want = Counter(i * i % 1000 for i in range(1, 3000))
    assert rows == {k: (n, n * k) for k, n in want.items()}


def check(docs, budget, k):
    rows = pack(docs, buckets=k, budget=budget).collect()
    want = Counter((r.doc_id, len((r.text or "").encode().split()) + 1) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want
    groups = defaultdict(list)
    for r in rows:
        assert r.padded_tokens >= r.n_tokens
        groups[r.batch_id].append(r)
    for group in groups.values():
        assert len({(r.bucket, r.padded_tokens) for r in group}) == 1
        assert sorted(r.position for r in group) == list(range(len(group)))
        assert len(group) == 1 or sum(r.padded_tokens for r in group) <= budget
    # Besides one batch per chunk all are full.
    for _, same in itertools.groupby(sorted(groups), key=lambda b: b.rsplit("-", 1)[0]):
        full = [len(groups[b]) == max(1, budget // groups[b][0].padded_tokens) for b in same]
        assert full.count(False) <= 1
    lengths = [r.n_tokens for r in rows]
    bounds = sorted({r.padded_tokens for r in rows})
    assert len(bounds) <= k and sum(r.padded_tokens - r.n_tokens for r in rows) == padding(lengths, bounds)


def test_batches(spark, documents, hard):
    check(documents.repartition(4), 4096, 16)
    check(documents, 300, 3)
    check(hard, 64, 4)
    whole = batches(pack(documents))
    assert whole.agg(F.sum("n_docs")).first()[0] == documents.count()
    assert all(r.n_padded <= 32768 and len(r.ids) == r.n_docs for r in whole.collect())


def test_own_lengths(spark, documents):
    rows = pack(documents, tokens=F.length("text") + 1, buckets=2).collect()
    assert Counter(r.n_tokens for r in rows) == Counter(len(r.text) + 1 for r in documents.collect())


def test_long_lengths_have_the_least_padding(spark):
    rng = random.Random(5)
    lengths = [rng.randrange(16384, 16512) for _ in range(400)]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, text long")
    rows = pack(docs, tokens=F.col("text"), buckets=4).collect()
    distinct, k = sorted(set(lengths)), 4
    best = [0] + [float("inf")] * len(distinct)
    count = Counter(lengths)
    for _ in range(k):
        now = [0] + [float("inf")] * len(distinct)
        for j in range(1, len(distinct) + 1):
            cost = 0
            for i in range(j, 0, -1):
                cost += count[distinct[i - 1]] * (distinct[j - 1] - distinct[i - 1])
                now[j] = min(now[j], best[i - 1] + cost)
        best = now
    assert sum(r.padded_tokens - r.n_tokens for r in rows) == best[-1]
