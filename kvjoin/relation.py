"""Relations: two columns, lvalue (the join key) and rvalue (the payload), with the key-domain rules.

Keys are unsigned 32-bit values of which 0 is reserved and those from 2**31 are out
of the domain. The rules are plain predicates on the scanned column, so they reach the
Parquet scan as pushed filters.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_KEY = 2**31 - 1
BANKS = 64  # per rank
TUPLE_BYTES = 8
SAMPLED = 32  # rows a bucket from which bounds are taken


class KeyDomainError(ValueError):
    pass


def load_column(spark: SparkSession, path: str, key: str, payload: str) -> DataFrame:
    """(lvalue, rvalue) of two integer columns of a Parquet table; only those two are read."""
    return relation(spark.read.parquet(path), key, payload)


def relation(df: DataFrame, key: str, payload: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("lvalue"), F.col(payload).cast("long").alias("rvalue"))


def valid_key(key: Column, reserved: int | None = 0) -> Column:
    ok = key.isNotNull() & (key >= 0) & (key <= MAX_KEY)
    return ok if reserved is None else ok & (key != reserved)


def nonzero(df: DataFrame, key: str = "lvalue") -> DataFrame:
    """Without the reserved key and null keys."""
    return df.where(F.col(key).isNotNull() & (F.col(key) != 0))


def violations(df: DataFrame, key: str = "lvalue") -> DataFrame:
    """Rows whose key is null, reserved or out of the domain, with the reason."""
    k = F.col(key)
    why = F.when(k.isNull(), "null").when(k == 0, "reserved").when(k < 0, "negative").when(k > MAX_KEY, "too large")
    return df.withColumn("reason", why).where(F.col("reason").isNotNull())


def checked(df: DataFrame, key: str = "lvalue") -> DataFrame:
    """df, whose execution fails at a key out of the domain; reserved keys are dropped."""
    k = F.col(key)
    bad = k.isNull() | (k < 0) | (k > MAX_KEY)
    held = F.when(bad, F.raise_error(F.concat(F.lit("key out of the domain: "), F.coalesce(k.cast("string"), F.lit("null")))).cast("long")).otherwise(k)
    return df.withColumn(key, held).where(F.col(key) != 0)


def padding(n: int, ranks: int) -> tuple[int, int]:
    """(padding tuples, tuples per bank) of n tuples dealt evenly over ranks * BANKS banks; an aligned n gets a full unit of padding."""
    unit = ranks * BANKS
    pad = unit - n % unit
    return pad, (n + pad) // unit


def placed(df: DataFrame, ranks: int, order: list[str], n: int) -> DataFrame:
    """df with pos (row number from 0 in the given total order), bank and rank of its placement.."""
    _, per_bank = padding(n, ranks)
    return numbered(df, order).withColumn("bank", F.floor(F.col("pos") / per_bank).cast("long")).withColumn("rank", F.floor(F.col("bank") / BANKS).cast("long"))


def bounds(df: DataFrame, order: list[str], buckets: int) -> list[tuple]:
    """Rows of the order columns, as strings, that cut df into about even buckets, from a uniform sample of at most SAMPLED rows a bucket. A pass over the columns, run at once; they only decide how even the buckets are."""
    names = [x.removeprefix("-") for x in order]
    rows = df.select(*names).orderBy(F.rand(7)).limit(SAMPLED * buckets)
    rows = [tuple(r) for r in rows.orderBy(*_keys(order)).select(*[F.col(x).cast("string") for x in names]).collect()]
    cuts = [rows[len(rows) * i // buckets] for i in range(1, buckets)] if rows else []
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


def _keys(order: list[str]) -> list[Column]:
    return [F.col(x[1:]).desc() if x.startswith("-") else F.col(x).asc() for x in order]


def _after(df: DataFrame, order: list[str], cuts: list[tuple]) -> Callable[[Column], Column]:
    """Of a place among the cuts: does the row come after that cut? Nulls as Spark sorts them. The cuts are constant arrays, one for each order column."""
    kinds = [dict(df.dtypes)[x.removeprefix("-")] for x in order]
    arrays = [F.from_json(F.lit(json.dumps([c[i] for c in cuts])), "array<string>").cast(f"array<{kind}>") for i, kind in enumerate(kinds)]

    def after(at: Column) -> Column:
        out = F.lit(False)
        for x, a in reversed(list(zip(order, arrays, strict=True))):
            c, v = F.col("`" + x.removeprefix("-").replace("`", "``") + "`"), F.get(a, at)
            beyond = (c < v) | (c.isNull() & v.isNotNull()) if x.startswith("-") else (c > v) | (c.isNotNull() & v.isNull())
            out = F.coalesce(beyond, F.lit(False)) | (c.eqNullSafe(v) & out)
        return out

    return after


def _halving(cuts: list[tuple], after: Callable[[Column], Column], low: Column, step: Column) -> Column:
    return F.when((low + step <= len(cuts)) & after(low + step - 1), low + step).otherwise(low)


def _steps(cuts: list[tuple]) -> list[int]:
    return [1 << k for k in reversed(range(len(cuts).bit_length()))]


def bucket(df: DataFrame, order: list[str], cuts: list[tuple]) -> Column:
    """How many of the cuts (from bounds()) come before the row, as one column, which no code is generated for; with_bucket() is several times faster."""
    after = _after(df, order, cuts)
    return F.aggregate(F.array(*map(F.lit, _steps(cuts))).cast("array<int>"), F.lit(0), lambda low, step: _halving(cuts, after, low, step))


def with_bucket(df: DataFrame, order: list[str], cuts: list[tuple], name: str) -> DataFrame:
    """df with the number of cuts that come before the row: a projection for each halving of a binary search. One expression for all of it
    would grow with the cuts, until its generated code is too long for the JVM to compile. The generator at the end keeps rules that follow a
    join's key down the plan from putting the projections into one another, which takes time exponential in their number."""
    after, out = _after(df, order, cuts), df.withColumn(name, F.lit(0))
    for step in _steps(cuts):
        out = out.withColumn(name, _halving(cuts, after, F.col(name), F.lit(step)))
    return out.withColumn(name, F.explode(F.array(name)))


def numbered(df: DataFrame, order: list[str], name: str = "pos", buckets: int | None = None) -> DataFrame:
    """df with the position of each row in a total order, from 0. order: columns, those with a leading - descending; nulls as Spark sorts them.

    Two levels, so that no task sees all rows: bounds of all the order columns together cut the order
    into buckets (many for each shuffle partition, so that hashing deals them evenly), each numbers its own rows in
    a window, and a table of one row for each bucket has the offsets. Only rows that are equal in all order columns
    can't be parted; they take consecutive numbers. One exchange of the rows, and one pass for the bounds as the plan is built.
    """
    if buckets is None:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(n, min(8 * n, 1024))
    b, n, o, r = ("_bucket", "_rows", "_offset", "_row")
    held = with_bucket(df, order, bounds(df, order, buckets), b)
    sizes = held.groupBy(b).agg(F.count(F.lit(1)).alias(n))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(b, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(o))
    ranked = held.withColumn(r, F.row_number().over(Window.partitionBy(b).orderBy(*_keys(order))))
    return ranked.join(F.broadcast(offsets), b).withColumn(name, (F.col(o) + F.col(r) - 1).cast("long")).drop(b, o, r)
