"""Group-bys: count, sum, minimum and maximum of a value by up to three keys; partial sums are made before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_KEYS = 3


def group_by(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    if len(keys) > MAX_KEYS:
        raise ValueError(f"at most {MAX_KEYS} keys")
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def squeeze(df: DataFrame, part: str, tid: str) -> DataFrame:
    """(part, n_rows, n_tids): how many distinct row ids are left in each partition."""
    return df.groupBy(part).agg(F.count(tid).alias("n_rows"), F.countDistinct(tid).alias("n_tids"))
