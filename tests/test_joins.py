from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.joins import heavy_keys, spread_join


@pytest.fixture
def rows(spark):
    """Half of the rows on one key, a third without any, the rest on many keys."""
    key = F.expr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 3 = 0 THEN NULL ELSE id % 1000 END")
    return spark.range(6000).select(key.alias("k"), F.lit("d").alias("d"), F.col("id").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_a_plain_join(spark, rows, how):
    right = spark.createDataFrame([(k, "d", k * 10) for k in range(0, 500)] + [(7, "d", 1), (None, "d", 2)], "k long, d string, w long")
    plain = rows.join(right, ["k", "d"], how)
    spread = spread_join(rows, right, ["k", "d"], F.col("v"), how)
    assert spread.columns == plain.columns
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, plain.collect()))


def test_only_heavy_keys_are_salted_by_their_weight(spark, rows):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = rows.where("k IS NOT NULL").count()
    heavy = {r.k: r._salts for r in heavy_keys(rows, ["k", "d"]).collect()}
    count = rows.where("k = 7").count()
    assert heavy == {7: -(-count * parts // named)}
    assert heavy_keys(rows.limit(0), ["k"]).count() == 0
    even = spark.range(1000).select((F.col("id") % 500).alias("k"))
    assert heavy_keys(even, ["k"]).count() == 0


def test_no_reducer_gets_much_more_than_its_share(spark, rows):
    """The join's own partitions: with a hot key, the longest stays below twice the mean."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    right = spark.range(1000).select(F.col("id").alias("k"), F.lit("d").alias("d"), F.lit(1).alias("w"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spread_join(rows, right, ["k", "d"], F.col("v"), "left")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plain = rows.join(right, ["k", "d"], "left").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 6000
    assert max(sizes) < 2 * 6000 / 8 < max(r["count"] for r in plain)
