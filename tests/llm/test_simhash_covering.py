import itertools
import random

import xxhash

from tallyframe.llm.simhash_covering import components, covering_masks, fingerprint_of, keep_first, links, near_duplicates


def brute_print(text, k=3):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, near):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in itertools.combinations(nodes, 2):
        if near(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 5000):
        text = " ".join(rng.choice(["Aa", "b", "é", "cC"]) for _ in range(n))
        assert fingerprint_of(text.encode().lower().split(), 3) == brute_print(text)


def test_masks_cover_every_pair_of_positions():
    masks = [m % (1 << 64) for m in covering_masks(2)]
    assert len(masks) == 7
    for a, b in itertools.combinations(range(64), 2):
        assert any(not m >> a & 1 and not m >> b & 1 for m in masks)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_and_components_equal_brute_force(spark):
    rng = random.Random(7)
    prints = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 12])):
            prints.add(x)
            for _ in range(rng.choice([1, 2, 3])):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << i for i in range(64)} | {centre ^ 1 << i ^ 1 << (i + 1) % 64 for i in range(64)}
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long").repartition(5)
    for radius in (1, 2):
        nodes = [signed(p) for p in prints]
        want = brute_components(nodes, lambda a, b, r=radius: ((a ^ b) % (1 << 64)).bit_count() <= r)
        edges = links(frame, radius)
        assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= radius for r in edges.collect())
        got = {r.node: r.root for r in components(edges).collect()}
        assert {p: got.get(p, p) for p in want} == want


def test_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(7, 7), (1000, 999)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {1000: 999}


def test_documents(spark, documents, hard):
    for docs in (documents, hard):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        prints = [(i, brute_print(t)) for i, t in rows]
        roots = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
        low = {}
        for i, p in prints:
            if i is not None:
                low[roots[p]] = min(i, low.get(roots[p], i))
        want = sorted(((i, f"{p:016x}", low.get(roots[p])) for i, p in prints), key=str)
        assert sorted(map(tuple, near_duplicates(docs.repartition(4)).collect()), key=str) == want
        kept = keep_first(docs)
        assert kept.columns == docs.columns
        named = [r.doc_id for r in kept.collect() if r.doc_id is not None]
        assert sorted(named) == sorted({i for i, _, c in want if i is not None and i == c})


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    alone, other = "a null id and words of its own", "nothing like the first one at all, not a word"
    rows = [(None, "x y z"), (4, "x y z"), (None, alone), (None, alone), (5, other), (5, "x y z"), (5, "q r s"), (5, "q r s")]
    rows += [(1, "m n o"), (1, "t u v"), (2, "m n o"), (3, "t u v")]
    assert len({brute_print(t) for _, t in rows}) == 6
    kept = keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(None, alone), (None, alone), (1, "m n o"), (1, "t u v"), (4, "x y z"), (5, other), (5, "q r s")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
