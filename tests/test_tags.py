import random

import oracle_py
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import has_tag, is_gateway_routed, parse_tag, tag_value

# Statement start, expected map (None for no or a void tag), expected has_tag.
CASES = [
    # Well formed: all fields, any order, any white space around them.
    (
        "/* abx route=bypass v=1 rule=nightly-7 ck=q4tz */ INSERT INTO sales VALUES (3)",
        {"route": "bypass", "v": "1", "rule": "nightly-7", "ck": "q4tz"},
        True,
    ),
    ("\t\r\n /*abx rule=r900 route=warehouse ck=m2 v=2*/ VALUES (2)", {"rule": "r900", "route": "warehouse", "ck": "m2", "v": "2"}, True),
    ("/*\tabx\nroute=cache_miss\r\nv=1*/x", {"route": "cache_miss", "v": "1"}, True),
    ("/* abx route=smaller_wh */", {"route": "smaller_wh"}, True),
    # No tag at all.
    ("VALUES (1)", None, False),
    ("/* bi: sheet 4 */ VALUES (1)", None, False),
    ("", None, False),
    (None, None, False),
    # Nothing between marker and end: one white space belongs to the marker.
    ("/* abx */ TABLE sales", None, False),
    ("/* abx  */ TABLE sales", {}, True),
    # A token without an equals sign voids the tag, a repeated key counts last.
    ("/* abx ck=m2 nightly route=bypass */ TABLE sales", None, True),
    ("/* abx route=bypass ck=m2 route=warehouse */ TABLE sales", {"route": "warehouse", "ck": "m2"}, True),
    ("/*abx left=right=top rule= */ TABLE sales", {"left": "right=top", "rule": ""}, True),
    ("/* abx =x ==y */ TABLE sales", {"": "=y"}, True),
    # Not the marker, not at the start, not closed, or with a star inside.
    ("/* Abx rule=r900 */ TABLE sales", None, False),
    ("/* abxrule=r900 */ TABLE sales", None, False),
    ("TABLE sales /* abx rule=r900 */", None, False),
    ("/* abx rule=r900", None, False),
    ("/* abx rule=r* */ TABLE sales", None, False),
    ("/* abx ck=m2 */ /* sheet 4 */ TABLE sales", {"ck": "m2"}, True),
]


def read(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    df = df.select(
        "i",
        parse_tag(t).alias("tag"),
        has_tag(t).alias("has"),
        tag_value(t, "rule").alias("rule"),
        tag_value(t, "route").alias("route"),
    )
    return sorted(df.collect(), key=lambda r: r.i)


def test_cases(spark):
    rows = read(spark, [t for t, _, _ in CASES])
    for row, (text, tag, has) in zip(rows, CASES, strict=True):
        assert (row.tag, row.has) == (tag, has), text
        assert row.rule == (tag or {}).get("rule") and row.route == (tag or {}).get("route"), text


def test_fuzz_against_brute_force(spark):
    rng = random.Random(3)
    heads = ["/* abx ", "/*abx ", "/*  abx\t", "\n/* abx ", "/* abx", "/* ab "]
    pieces = ["v=1", "rule=", "rule=r1", "rule=r2", "route=a", "bad", "=", "==", "*", " ", "  ", "\x1f", "　", "é=ß", "/"]
    texts = [
        rng.choice(heads) + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))) + rng.choice([" */ x", "*/", ""])
        for _ in range(5_000)
    ]
    for row, text in zip(read(spark, texts), texts, strict=True):
        assert row.tag == oracle_py.parse_tag(text), text
        assert row.has == (oracle_py.tag_match(text) is not None), text


def test_tag_with_very_many_fields(spark):
    text = "/* abx " + " ".join(f"k{i % 5000}={i}" for i in range(20_000)) + " */ SELECT 1"
    (row,) = read(spark, [text])
    assert row.tag == oracle_py.parse_tag(text)


@pytest.mark.parametrize(
    "text, routed",
    [
        ("/* abx v=1 */ SELECT 1", True),
        ("/* abx not closed", True),
        (" /* abx v=1 */ SELECT 1", False),
        ("/*abx v=1 */ SELECT 1", False),
        ("SELECT 1", False),
        (None, None),
    ],
)
def test_strict_prefix(spark, text, routed):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_gateway_routed(F.col("t"))).first()[0] is routed
