"""Typed selections. Operation codes: 0 equal (integers only), 1 <=, 2 >=, 3 <, any other >.

All are filters on the column itself, so Catalyst pushes them to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_IN, MAX_CONTAINS, MAX_PREFIX = 8, 30, 16


def compare(c: Column, code: int, value: object, integer: bool = False) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    if integer and code == 0:
        return c == v
    return {1: c <= v, 2: c >= v, 3: c < v}.get(code, c > v)


def is_in(c: Column, values: list) -> Column:
    if len(values) > MAX_IN:
        raise ValueError(f"at most {MAX_IN} values")
    return c.isin(*values)


def between(c: Column, low: object, high: object, is_double: bool = False) -> Column:
    """Exclusive at both ends for doubles, inclusive for others."""
    return (c > low) & (c < high) if is_double else c.between(low, high)


def contains(c: Column, pattern: str) -> Column:
    if len(pattern) > MAX_CONTAINS:
        raise ValueError(f"at most {MAX_CONTAINS} characters")
    return c.contains(pattern)


def is_prefix_of(c: Column, constant: str) -> Column:
    """The column is a prefix of the constant."""
    if len(constant) > MAX_PREFIX:
        raise ValueError(f"at most {MAX_PREFIX} characters")
    return F.lit(constant).startswith(c)


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two lists of row ids, each once."""
    return a.union(b).distinct()


def encode(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """df with an integer code for each distinct value of the column, in order from 0: a dictionary and a join."""
    from kvjoin.relation import numbered

    words = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
    return df.join(words, column)
