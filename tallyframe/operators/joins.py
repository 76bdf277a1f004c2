from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys with more rows than a reducer's share, and over how many ``_salts`` theirs should be spread.

    With P shuffle partitions a share is a P-th of all rows: there are fewer than P such keys, and their salts
    together are at most twice P.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = reduce(and_, (F.col(name).isNotNull() for name in on))
    sizes = rows.where(named).groupBy(*on).agg(F.count("*").alias("_rows"))
    total = sizes.agg(F.sum("_rows")).scalar()
    return sizes.where(F.col("_rows") * parts > total).select(*on, F.ceil(F.col("_rows") * parts / total).alias("_salts"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner") -> DataFrame:
    """Equi-join whose heavy left keys are spread over several reducers, each by its measured weight.

    ``right`` is an aggregate or dimension with few rows per key; those of a heavy key are repeated once per salt, all
    others stand once. The salt of a left row is a hash of ``spread``, so a retried task sends it to the same
    reducer. Rows with a NULL key match nothing; in an outer join they take the whole hash as salt and spread
    over all reducers. The heavy keys, fewer than there are shuffle partitions, are broadcast; whether ``right`` is small
    enough for that is decided from its size.
    """
    hashed = F.xxhash64(spread)
    heavy = F.broadcast(heavy_keys(left, on))
    null_key = reduce(lambda a, b: a | b, (F.col(name).isNull() for name in on))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    # Neither branch can be NULL, which keeps a NULL test of the hash out of the scan below.
    salt = F.when(null_key, hashed).otherwise(F.coalesce(F.pmod(hashed, salts), hashed))
    repeated = right.join(heavy, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    salted = left.join(heavy, on, "left").withColumn("_salt", salt).drop("_salts")
    return salted.join(repeated.drop("_salts"), [*on, "_salt"], how).drop("_salt")
