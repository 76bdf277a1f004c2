"""Apportionment of a total in whole units, so that the shares add up to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def apportion(
    shares: DataFrame, group: list[str], key: list[str], weight: str = "weight", total: str = "total", out: str = "units"
) -> DataFrame:
    """``shares`` with ``out``: the whole units of the group's ``total`` that fall to each row, by largest remainder.

    ``weight`` and ``total`` are whole numbers of decimal type and not negative; ``total`` is the same in all rows of a
    group. Every row gets the whole part of its quota, and the units left over go to the rows with the largest
    remainders, of equal ones to the first by ``key``. All is exact integer arithmetic, so shares add up to the total
    and do not depend on the order of rows. A group whose weights are all zero gets nothing.

    A group is handled as one: it must be small by its nature, like the days of a window or the SKUs of a day.
    """
    whole = Window.partitionBy(*group)
    quota = F.col(total).cast("decimal(19,0)") * F.col(weight).cast("decimal(19,0)")
    divided = (
        shares.withColumn("_sum", F.sum(weight).over(whole).cast("decimal(19,0)"))
        .where("_sum > 0")
        .withColumn("_quota", quota.cast("decimal(38,0)"))
        .withColumn("_base", F.expr("_quota div _sum"))
        .withColumn("_rest", F.col("_quota") - F.col("_base").cast("decimal(19,0)") * F.col("_sum"))
        .withColumn("_left", F.col(total).cast("long") - F.sum("_base").over(whole))
        .withColumn("_place", F.row_number().over(whole.orderBy(F.desc("_rest"), *key)))
    )
    extra = (F.col("_place") <= F.col("_left")).cast("long")
    return divided.withColumn(out, F.col("_base") + extra).drop("_sum", "_quota", "_base", "_rest", "_left", "_place")
