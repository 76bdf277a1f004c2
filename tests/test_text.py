import random
import time

import oracle_py
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import (
    FP_VERSION,
    fingerprint,
    fingerprint_versioned,
    mask_numbers,
    mask_strings,
    normalize_sql,
    squeeze,
    strip_block,
    strip_line,
    to_number,
    to_second,
)

# Vectors of the contract for algorithm version 1 (text, normalized form, fingerprint).
GOLDEN = [
    ("", "", "4oymiquy7qobjgx3"),
    (None, "", "4oymiquy7qobjgx3"),
    ("SELECT 1", "select ?", "4hdr2ftbvzdobg32"),
    ("SELECT id FROM users WHERE id = 1", "select id from users where id = ?", "uirvvz3a27wxpv3q"),
    ("SELECT id, name FROM users WHERE id = 1", "select id, name from users where id = ?", "vsmlyj2qpbhmn6tj"),
    ("SELECT * FROM orders WHERE status = 'pending'", "select * from orders where status = ?", "cva3v37pb4uqblgo"),
    ("SELECT * FROM orders WHERE amount > 100", "select * from orders where amount > ?", "n6wonaxlq3qenmn7"),
    ("SELECT * FROM t WHERE id = 1", "select * from t where id = ?", "rdsbmuvvopcahqgb"),
    ("SELECT * FROM t WHERE a = 'foo'", "select * from t where a = ?", "em65zeono44gd5sr"),
    ("SELECT * FROM t WHERE a = 'foo' AND b = 'bar'", "select * from t where a = ? and b = ?", "5llwas6iwlphndou"),
    ("SELECT * FROM t WHERE x BETWEEN 10 AND 20", "select * from t where x between ? and ?", "sjw3oowiglicrhua"),
    ("SELECT id FROM t", "select id from t", "3nsd42abayx4fysh"),
    ("SELECT * FROM users", "select * from users", "y2zx7sghcfxeu7e6"),
    ("SELECT * FROM orders", "select * from orders", "rv2nkpj3y4twnsob"),
    ("select 'a--b' from t", "select 'a", "uso4yac5av7qj3zw"),
    ("select a/**/b", "select ab", "xwlgbo7zexr2cuz3"),
    ("SELECT x IN (1,2)", "select x in (?,?)", "t5p5a6r7comelisg"),
    ("SELECT x IN (1,2,3)", "select x in (?,?,?)", "3brjdu6xgjz6mtn4"),
    ("/* abx never closed", "/* abx never closed", "3of74onur7ocgphk"),
    (
        "select 'it''s', .5, 1e5, -7, 1.2.3, t1.c2, 1_000, 0x1F, \"y2 3\"",
        'select ??, .?, 1e5, -?, ?.?, t1.c2, 1_000, 0x1f, "y2 ?"',
        "y26caawkwpmk26ra",
    ),
]

# Texts that must share a fingerprint.
SAME = [
    ("SELECT city FROM shops WHERE id = 7", "Select City From Shops Where Id = 7"),
    ("SELECT city FROM shops WHERE id = 7", "  SELECT\n\tcity\r\nFROM   shops\u00a0WHERE id  =  7 "),
    ("SELECT city FROM shops WHERE id = 7", "SELECT city FROM shops WHERE id = 70.25"),
    ("SELECT city FROM shops WHERE kind = 'book'", "SELECT city FROM shops WHERE kind = 'caf\u00e9 -_-'"),
    ("UPDATE shops SET a = 'x', b = 'y'", "update shops set a = '', b = 'it\\'s'"),
    ("SELECT 1 FROM shops LIMIT 5, 6", "SELECT 2 FROM shops LIMIT 77, 888"),
    ("SELECT city FROM shops", "/* abx v=1 ck=q rule=r9 route=bypass */ SELECT /* all */ city FROM shops"),
    ("SELECT city FROM shops", "SELECT city -- name\nFROM shops -- end"),
]

PIECES = (
    ["/*", "*/", "--", "\n", "'", "\\", "\\'", "''", "*", ".", "-", "_", "=", "a", "B", "x1", "1e5", "1", "23", "4.5"]
    + [" ", "  ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​"]
    + ["é", "İ", "ß", "Σ", "ΑΣ ", "K", "漢", "٣", "²", "Ⅷ", "́", "\U00010400", "\U0001d7d9", "\U0001f600"]
)


def column(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "i int, t string")


def apply(spark, fn, texts):
    df = column(spark, texts).select("i", fn(F.col("t")).alias("v"))
    return [r.v for r in sorted(df.collect(), key=lambda r: r.i)]


def test_golden_values(spark):
    texts = [t for t, _, _ in GOLDEN]
    assert apply(spark, normalize_sql, texts) == [n for _, n, _ in GOLDEN]
    assert apply(spark, fingerprint, texts) == [ck for _, _, ck in GOLDEN]


def test_equal_up_to_literals_comments_case_and_spacing(spark):
    assert apply(spark, fingerprint, [a for a, _ in SAME]) == apply(spark, fingerprint, [b for _, b in SAME])


def test_shape_of_fingerprint(spark):
    texts = ["SELECT * FROM users", "UPDATE parts SET price = price * 1.07 WHERE maker = 'M-12'", "x" * 5000]
    keys = apply(spark, fingerprint, texts)
    assert len(set(keys)) == 3
    assert all(len(k) == 16 and set(k) <= set("abcdefghijklmnopqrstuvwxyz234567") for k in keys)


def test_version(spark):
    row = column(spark, ["SELECT 1"]).select(*fingerprint_versioned(F.col("t"))).first()
    assert (row.ck, row.fp_version) == ("4hdr2ftbvzdobg32", FP_VERSION)


@pytest.mark.parametrize(
    "fn, text, want",
    [
        (strip_block, "/* c */ SELECT /**/1 /* open", " SELECT 1 /* open"),
        (strip_block, "/*/ a */b", "b"),
        (strip_block, "/*/", "/*/"),
        (strip_block, "a /* x\ny */ b /* z */", "a  b "),
        (strip_line, "SELECT 1 -- t\nFROM t --", "SELECT 1 \nFROM t "),
        (squeeze, " a   b\t\nc d\x1ce ", "a b c d e"),
        (mask_strings, "a = 'x' and b = 'it''s' or 'open", "a = ? and b = ?? or 'open"),
        (mask_strings, r"'a\'b' '\\' 'c\' d", r"? ? 'c\' d"),
        (mask_numbers, "1 1.5 a1 1a 1.2.3 1_0 -7 .5 7. 12.3b", "? ? a1 1a ?.? 1_0 -? .? ?. ?.3b"),
    ],
)
def test_steps(spark, fn, text, want):
    assert apply(spark, fn, [text]) == [want]


def test_fuzz_against_brute_force(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(20_000)]
    got = zip(texts, apply(spark, normalize_sql, texts), apply(spark, fingerprint, texts), strict=True)
    wrong = [t for t, n, ck in got if n != oracle_py.normalize(t) or ck != oracle_py.fingerprint(t)]
    assert wrong == []


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("text", fingerprint(F.col("text")).alias("ck")).collect()
    assert rows and all(r.ck == oracle_py.fingerprint(r.text) for r in rows)


def test_hostile_texts_take_linear_time(spark):
    n = 300_000
    texts = [
        "select '" + "x" * n + "' from t",
        "select '" + r"\'" * n,  # no closing quote, every quote a candidate
        "/*x" * n,
        "/* abx " + " " * n + "x" * n,
        "1" * n + "a",
        "-" * n,
        " " * n + "x",
        "'" * n,
    ]
    start = time.perf_counter()
    got = apply(spark, normalize_sql, texts)
    assert time.perf_counter() - start < 60
    assert got[0] == "select ? from t"
    assert got[1] == texts[1] and got[2] == texts[2] and got[4] == texts[4]
    assert got[5] == "" and got[6] == "x" and got[7] == "?" * (n // 2)


def test_scalars(spark):
    df = spark.sql("SELECT '1.5' AS a, '1e3' AS b, 'x' AS c, timestamp'2024-01-02 03:04:05.678' AS t")
    row = df.select(
        to_number(F.col("a")).alias("a"),
        to_number(F.col("b")).alias("b"),
        to_number(F.col("c")).alias("c"),
        to_second(F.col("t")).cast("string").alias("t"),
    ).first()
    assert tuple(row) == (1.5, 1000.0, None, "2024-01-02 03:04:05")
