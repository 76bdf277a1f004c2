"""Small helpers of the operators: tables, stored intermediate results, null-safe keys."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession

from tallyframe.sources.shared import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder, with the session's or the given compression, and read back.

    This cuts the lineage, so a lost executor does not repeat the work before it, and gives later joins
    exchanges of their own, which adaptive execution can split.
    """
    path = new_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of the named columns of two frames; null equals null."""
    return reduce(and_, (left[n].eqNullSafe(right[n]) for n in names))
