import random

import numpy as np
import pytest

from tallyframe.llm.substring_dedup import COVERS, _combined, substring_dedup


def brute(rows, k=13):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        if i is not None:
            for s in range(len(w) - k + 1):
                key = tuple(w[s : s + k])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        if i is not None:
            for s in range(len(w) - k + 1):
                if first[tuple(w[s : s + k])] < i:
                    gone.update(range(s, s + k))
        out.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return sorted(out, key=str)


def check(df, rows, **how):
    got = sorted(map(tuple, substring_dedup(df, **how).collect()), key=str)
    assert got == brute(rows, how.get("window", 13))


@pytest.mark.parametrize("period", sorted(COVERS))
def test_covers(period):
    for a in range(period):
        for b in range(period):
            assert any((a + d) % period in COVERS[period] and (b + d) % period in COVERS[period] for d in range(period))


def test_hard_texts(hard):
    check(hard.repartition(3), [(r.doc_id, r.text) for r in hard.collect()])


@pytest.mark.parametrize("period", [3, 7, 13])
def test_shared_passages(spark, period):
    rng = random.Random(period)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 9)
    passages = [[word() for _ in range(n)] for n in (5, 12, 13, 14, 20, 60)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            words[(at := rng.randrange(len(words) + 1)) : at] = rng.choice(passages)
        rows.append((i * 37 % 149, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows, period=period)


def test_words_that_repeat_within_one_document(spark):
    rows = [(1, "z " * 40), (2, "y " * 12 + "z " * 14), (3, "z " * 12), (4, "q w " * 30), (5, "w q " * 30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_repeated_id_with_a_copy_and_a_text_of_its_own(spark):
    copy, own = " ".join(f"c{i}" for i in range(20)), " ".join(f"o{i}" for i in range(20))
    rows = [(1, copy), (2, copy), (2, own), (3, "new " + own), (4, copy), (4, copy), (5, ""), (6, None), (6, "x " + copy)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_combining_settles_all_but_the_smallest_id():
    ids, hashes = np.array([5, 3, 3, 9, 4]), np.array([1, 1, 1, 2, 1])
    order, kind = _combined(ids, hashes, np.zeros(5, np.int32))
    assert [(int(hashes[i]), int(ids[i]), int(k)) for i, k in zip(order, kind)] == [(1, 5, 2), (1, 3, 1), (2, 9, 0), (1, 4, 2)]
