"""Equi-joins of two relations: (payload of the build side, payload of the probe side) for equal valid keys.

The algorithm is a request to Catalyst (a join hint), the answer is always the same.
"phj" shuffled hash, "smj" sort-merge, "nl" nested loop, "nphj" broadcast hash (only
behind a size check), "mpsm" sort-merge over ranges of the key that both sides share. Adaptive
execution splits skewed probe keys of "phj" and "smj"; the ranges of "mpsm" stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvjoin.relation import bounds, checked, valid_key, with_bucket

ALGORITHMS = ("phj", "smj", "nl", "nphj", "mpsm")
#: Rows up to which the build side is broadcast, and the product of rows up to which a nested loop is run; beyond, the sort-merge join.
BROADCAST_ROWS, LOOP_PAIRS = 2_000_000, 50_000_000


class DuplicateKeyError(ValueError):
    pass


def _sides(left: DataFrame, right: DataFrame, reserved: int | None) -> tuple[DataFrame, DataFrame]:
    r = left.where(valid_key(F.col("lvalue"), reserved)).select(F.col("lvalue").alias("rk"), F.col("rvalue").alias("rv"))
    s = right.where(valid_key(F.col("lvalue"), reserved)).select(F.col("lvalue").alias("sk"), F.col("rvalue").alias("sv"))
    return r, s


def duplicates(build: DataFrame) -> DataFrame:
    """(lvalue, n) of keys that occur more than once among the valid ones."""
    return build.where(valid_key(F.col("lvalue"))).groupBy("lvalue").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join(left: DataFrame, right: DataFrame, algorithm: str = "phj", reserved: int | None = 0, strict: bool = False) -> DataFrame:
    """(lvalue, rvalue): payload of left and of right for each pair of rows with equal keys.

    Rows with null, reserved or out-of-domain keys don't match. strict: a key out of the domain or a
    key that the build side (left) has twice raises; otherwise all matches are returned.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"algorithm: {algorithm}")
    if strict:
        left, right = checked(left), checked(right)
        if not (twice := duplicates(left)).isEmpty():
            raise DuplicateKeyError(f"build keys that occur more than once, such as {twice.first()['lvalue']}")
    r, s = _sides(left, right, reserved)
    if algorithm == "mpsm":
        r, s = ranges(r, s)
        return r.hint("merge").join(s, (F.col("rb") == F.col("sb")) & (F.col("rk") == F.col("sk"))).select(F.col("rv").alias("lvalue"), F.col("sv").alias("rvalue"))
    on = F.col("rk") == F.col("sk")
    if algorithm == "nphj" and left.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        algorithm = "smj"
    if algorithm == "nl" and left.count() * right.count() > LOOP_PAIRS:
        algorithm = "smj"
    hint = {"phj": "shuffle_hash", "smj": "merge", "nl": "shuffle_replicate_nl", "nphj": "broadcast"}[algorithm]
    return r.hint(hint).join(s, on).select(F.col("rv").alias("lvalue"), F.col("sv").alias("rvalue"))


def ranges(r: DataFrame, s: DataFrame, build: str = "rk", probe: str = "sk") -> tuple[DataFrame, DataFrame]:
    """Both sides with the range of their key (rb, sb), dealt out by it: one set of bounds, from the build keys, cuts both, so the merge join needs no further exchange."""
    n = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = bounds(r, [build], n)
    return with_bucket(r, [build], cuts, "rb").repartition(n, "rb"), with_bucket(s, [probe], cuts, "sb").repartition(n, "sb")


def probe(left: DataFrame, right: DataFrame) -> DataFrame:
    """At most one match per probe row: (key, rvalue, hit). With repeated build keys the row still counts once."""
    keys = left.where(valid_key(F.col("lvalue"))).select(F.col("lvalue").alias("rk")).distinct().withColumn("found", F.lit(True))
    s = right.where(valid_key(F.col("lvalue")))
    return s.join(keys, s["lvalue"] == keys["rk"], "left").select(F.col("lvalue").alias("key"), "rvalue", F.coalesce("found", F.lit(False)).alias("hit"))


def probe_stats(left: DataFrame, right: DataFrame) -> DataFrame:
    """(probed, hits, unmatched), one row; hits + unmatched = probed."""
    p = probe(left, right)
    return p.agg(F.count(F.lit(1)).alias("probed"), F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("unmatched"))


def in_place(left: DataFrame, right: DataFrame) -> DataFrame:
    """The in-place variant's output: probe rows without a match stay, with their key in place of the build payload."""
    r, s = _sides(left, right, 0)
    return s.join(r, F.col("rk") == F.col("sk"), "left").select(F.coalesce("rv", "sk").alias("lvalue"), F.col("sv").alias("rvalue"))


def padded(result: DataFrame, tuples: int) -> DataFrame:
    """A dumped result: its rows and so many zero tuples as padding. A result can have pairs of zeros of its own, so effective says which rows are the result's."""
    pad = result.sparkSession.range(tuples).selectExpr("0L AS lvalue", "0L AS rvalue", "false AS effective")
    return result.select("lvalue", "rvalue", F.lit(True).alias("effective")).union(pad)


def finish(result: DataFrame) -> DataFrame:
    """Without the zero tuples that pad a dumped result: of padded(), the effective rows, whatever their values. A bare
    dump does not tell padding from pairs of zeros that matched, so it loses both; rows with a null stay."""
    if "effective" in result.columns:
        return result.where("effective").drop("effective")
    return result.where(~(F.col("lvalue").eqNullSafe(0) & F.col("rvalue").eqNullSafe(0)))


def theta(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    """Nested loop over a condition on rk, rv, sk, sv; equality conditions still use a hash. left is broadcast if it has at most BROADCAST_ROWS rows (counted at once), else pairs of partitions meet; its work is the product of the sides."""
    r, s = _sides(left, right, 0)
    if left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        r = F.broadcast(r)
    return r.join(s, F.expr(condition)).select(F.col("rv").alias("lvalue"), F.col("sv").alias("rvalue"))


class JoinInstance:
    """load() two relations by name, then join(): the library's whole host interface."""

    def __init__(self, spark, partitions: int | None = None):
        self.spark, self.relations = spark, {}
        self.partitions = partitions

    def load(self, name: str, df: DataFrame) -> None:
        if name not in ("left", "right"):
            raise ValueError(f"relation: {name}")
        if name in self.relations:
            raise ValueError(f"{name} is loaded already")
        self.relations[name] = df.select(F.col(df.columns[0]).cast("long").alias("lvalue"), F.col(df.columns[1]).cast("long").alias("rvalue"))

    def free(self, name: str) -> None:
        if name not in self.relations:
            raise ValueError(f"not loaded: {name}")
        self.relations.pop(name).unpersist()

    def join(self, algorithm: str = "phj", strict: bool = False) -> DataFrame:
        missing = {"left", "right"} - set(self.relations)
        if missing:
            raise ValueError(f"not loaded: {', '.join(sorted(missing))}")
        left, right = self.relations["left"], self.relations["right"]
        if self.partitions:
            left, right = left.repartition(self.partitions, "lvalue"), right.repartition(self.partitions, "lvalue")
        return join(left, right, algorithm, strict=strict)
