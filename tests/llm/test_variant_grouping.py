import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.llm.variant_grouping import LONG, SAME, SHORT, count_words, group_variants, near_pairs, roots, signatures

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def brute_words(rows, least, count):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least and n >= count}


def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, count=3):
    words = brute_words(rows, least, count)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: r[0])


def test_documents(documents):
    docs = documents.where("doc_id < 60")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(group_variants(docs))
    assert got == brute(rows)
    assert any(r[1] is not None for r in got)


def test_hard_texts(hard):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert result(group_variants(hard.repartition(4))) == brute(rows)


def test_ties_chains_and_losses(spark):
    texts = ["aaaaab " * 3, "aaaaac " * 7, "aaaaad " * 7, "aaaaadd " * 14, "aaaaaddd " * 40, "ÉCOLE école " * 3, "ÀÉaeiou " * 4]
    texts += ["word%s " % "".join(chr(97 + (i // 26**k) % 26) for k in range(3)) * 3 for i in range(200)]
    rows = list(enumerate(texts)) + [(None, "lonely " * 5), (3, None), (4, "aaaaaddd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: r for r in result(group_variants(docs))}
    assert sorted(got.values()) == brute(rows)
    assert got["aaaaab"][1:3] == ("aaaaac", "aaaaac")  # the smaller of equal counts
    assert got["aaaaad"][1:3] == ("aaaaadd", "aaaaaddd")  # along the chain


def test_every_lost_code_point(spark):
    rows = [(i, "abcdefgh " * 3) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(group_variants(docs.repartition(7))) == brute(rows)
    assert {r.word for r in count_words(docs, lossy=0).collect()} == {"abcdefgh"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert group_variants(docs).collect() == []


words = st.text("abcé", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_near_words_share_a_signature(a, b):
    if a == b or not one_edit(a, b):
        return
    by_role = [{s for r, s in signatures(w) if r == role} for role in (SAME, SHORT, LONG) for w in (a, b)]
    same_a, same_b, short_a, short_b, long_a, long_b = by_role
    if len(a) == len(b):
        assert same_a & same_b
    else:
        assert (short_a & long_b) if len(a) < len(b) else (long_a & short_b)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij"])
def test_pairs_of_many_words(spark, alphabet):
    n = len(alphabet)
    made = ["".join(alphabet[(i * i * 7 + i // n**k) % n] for k in range(6)) for i in range(900)]
    unique = sorted(set(made) | {w + w[0] for w in made[:300]} | {w[1:] + "zz" for w in made[:50]})
    frame = spark.createDataFrame([(w, 3) for w in unique], "word string, n long")
    got = [(r.word, r.near) for r in near_pairs(frame).collect()]
    want = {(a, b) for a in unique for b in unique if a != b and one_edit(a, b)}
    assert len(got) == len(want) and set(got) == want


def test_long_chain_of_forms(spark):
    chain = spark.range(1, 1000).select(
        F.format_string("w%04d", "id").alias("word"), F.format_string("w%04d", F.col("id") - 1).alias("form")
    )
    assert {r.root for r in roots(chain).collect()} == {"w0000"} and roots(chain).count() == 999
