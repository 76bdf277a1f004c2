import random
import re

from tallyframe.llm.decontaminate import decontaminate, drop_contaminated


def words_of(text):
    folded = (text or "").encode().lower().decode()
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def brute(docs, items, k=13):
    windows = {}
    for i, t in items:
        w = words_of(t)
        for s in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        found.discard(None)
        out.append((i, len(w), len(hit), sorted(found, key=str), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def cases(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "été", "x1", "ÉTÉ", "the", "a"]
    passage = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, passage(rng.choice([1, 5, 12, 13, 14, 40]))) for i in range(20)]
    items += [(100, ""), (101, None), (102, "..."), (None, passage(15)), (7, items[7][1]), (103, "solo-word"), (9, passage(13))]
    docs = []
    for i in range(120):
        parts = [passage(rng.randrange(0, 30))]
        if rng.random() < 0.6:
            parts.append(rng.choice(items)[1] or "")
        parts.append(passage(rng.randrange(0, 300)))
        docs.append((i, rng.choice([" ", "\n", " -- ", " , "]).join(parts).replace(" ", rng.choice([" ", "  ", ", "]))))
    return docs, items


def test_against_brute_force(spark, hard):
    docs, items = cases(spark)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rows, frame in ((docs, None), ([(r.doc_id, r.text) for r in hard.collect()], hard)):
        frame = frame or spark.createDataFrame(rows, "doc_id long, text string")
        want = brute(rows, items)
        for block in (32 << 20, 600):  # one automaton, and many blocks
            got = decontaminate(frame.repartition(3), bench, block_bytes=block).drop("spans").collect()
            assert sorted(map(tuple, got), key=str) == want
        kept = drop_contaminated(frame, bench)
        assert kept.columns == frame.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((w[0] for w in want if not w[4]), key=str)


def test_spans_point_into_the_original(spark):
    item = "Où est la bibliothèque de la ville, s'il vous plaît madame Dupont merci bien"
    text = "Éé中! Prelude… OÙ EST\nla  Bibliothèque de la ville s il vous plaît Madame DUPONT merci! fin"
    bench = spark.createDataFrame([(1, item.replace("Où", "OÙ"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = decontaminate(docs, bench).first()
    (span,) = row.spans
    assert text[span["from"] : span["upto"]] == text[text.index("OÙ") : text.index("! fin")]
    assert (row.n_hit, row["items"]) == (14, [1])


def test_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontaminate(docs, spark.createDataFrame([], "item_id long, text string")).first()[:] == (1, 2, 0, [], [], False)
