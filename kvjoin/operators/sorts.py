"""Sorts as total orders; the algorithm's name is accepted and makes no difference to the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvjoin.relation import nonzero, numbered

ALGORITHMS = ("quick", "radix", "merge")
BUCKET_ROWS = 256 * 0.4  # fill target of a sort bucket


def sort(df: DataFrame, algorithm: str = "quick", order: tuple[str, ...] = ("lvalue", "rvalue")) -> DataFrame:
    """df with pos, its place in the order of key and payload; "radix" and "merge" are names for the same, any other is quick."""
    return numbered(df, list(order))


def sort_rows(df: DataFrame, order: list[str], ascending: bool = True) -> DataFrame:
    """df in order, globally: a range exchange and a sort in each partition."""
    return df.orderBy(*order, ascending=ascending)


def bucket_histogram(df: DataFrame, fill: float = BUCKET_ROWS) -> DataFrame:
    """(bucket, n): equi-width ranges between the smallest and the largest key, about fill rows each if keys are even."""
    k = nonzero(df).select("lvalue")
    low, high, n = k.agg(F.min("lvalue"), F.max("lvalue"), F.count(F.lit(1))).first()
    buckets = max(int((n or 0) / fill), 1)
    width = max(((high or 0) - (low or 0)) // buckets, 1)
    b = F.least(F.floor((F.col("lvalue") - F.lit(low or 0)) / width), F.lit(buckets - 1)).cast("long")
    return k.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sort_tids(df: DataFrame, column: str, tid: str, ascending: bool = True) -> DataFrame:
    """(pos, tid): row ids in the order of a column; ties in the order of the ids."""
    return numbered(df.select(column, tid), [column if ascending else f"-{column}", tid]).select("pos", F.col(tid).cast("long").alias("tid"))
