"""The pipeline against its stages' brute-force versions, each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
import pytest
import test_decontaminate
import test_exact_dedup
import test_simhash_covering

from tallyframe.llm.quality_crf import classify


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in classify(docs, labels).collect() if r.predicted}
    want = [good]
    rows = [(i, texts[i]) for i in sorted(good)]
    want.append({r[0] for r in test_exact_dedup.brute(rows) if r[3]})
    prints = {i: test_simhash_covering.brute_print(texts[i]) for i in want[-1]}
    roots = test_simhash_covering.brute_components(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i in sorted(prints):
        first.setdefault(roots[prints[i]], i)
    want.append(set(first.values()))
    rows = [(i, texts[i]) for i in sorted(want[-1])]
    hit = test_decontaminate.brute(rows, [(r.item_id, r.text) for r in items.collect()])
    want.append({r[0] for r in hit if not r[4]})
    want.append(want[-1])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert Counter(r.doc_id for r in docs.select("doc_id").collect()) == Counter(want[k]), name
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, docs.collect()))


def tables(spark, folder, docs, labels, items):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def clean(documents):
    """Texts that the classifier keeps and that stay apart."""
    texts = [r.text for r in documents.orderBy("doc_id").collect() if r.text and len(r.text) > 300]
    return list(dict.fromkeys(texts))[:30]


def test_empty_tables(spark, sf, tmp_path):
    empty = [spark.read.parquet(f"{sf}/{t}.parquet").limit(0) for t in ("documents", "labels", "benchmark")]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, *empty))
    assert out.columns == corpus_pipeline.run(spark, sf).columns and out.count() == 0


def test_hard_rows(spark, sf, tmp_path, clean):
    """Null texts and ids, empty, very long and repeated rows, ties, and columns named like those of the stages."""
    rows = [(i, t, "x", "y") for i, t in enumerate(clean)]
    rows += [(100, clean[0].upper(), "x", "y"), (101, clean[1] + " ", "x", "y"), (102, clean[2] + clean[3] * 200, "x", "y")]
    rows += [(None, clean[4], None, "y"), (None, None, "x", None), (103, None, None, None), (104, "", "x", "y"), (105, " ", "x", "y")]
    rows += [rows[5], rows[5], (106, "one", "x", "y"), (107, "word " * 20000, "x", "y")]
    extra = "fp hit row hits kept_id digest score predicted component_id n_tokens bucket batch_id".split()
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (3, None, None)], labels.schema))
    items = items.unionByName(spark.createDataFrame([(None, "a b"), (900, None), (901, "")], items.schema))
    folder = tables(spark, tmp_path, docs, labels, items)
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r.doc_id, r.text) for r in kept.collect()} if k < 4 else None
        stage(spark, kept, folder).write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k < 4:
            assert kept.columns == docs.columns
            assert {(r.doc_id, r.text) for r in kept.collect()} <= before
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted((r.doc_id for r in corpus_pipeline.run(spark, folder).collect()), key=str)
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)), "repeated rows are one document"
    # Documents without words are copies or near copies of each other.
    assert len({103, 104, 105} & set(ids)) <= 1
