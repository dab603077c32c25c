"""Invariants of partitioning, sorts, selections, projections, group-bys and plans."""

import random

import pytest
from pyspark.sql import functions as F

from kvjoin.operators import aggregates, partition, projections, selections, sorts
from kvjoin.plans.steps import PlanError, run_plan
from kvjoin.relation import bounds, bucket, numbered, placed, with_bucket


@pytest.fixture(scope="module")
def keys(spark):
    df = spark.range(3000).select((F.col("id") * 37 % 2500).alias("lvalue"), F.col("id").alias("rvalue"))
    return placed(df, 2, ["lvalue", "rvalue"], 3000).cache()


def test_positions(keys):
    got = sorted(tuple(r) for r in keys.select("pos", "lvalue", "rvalue").collect())
    assert [r[0] for r in got] == list(range(3000))
    assert [r[1:] for r in got] == sorted(r[1:] for r in got)


def test_partitions(keys):
    valid = keys.where("lvalue <> 0").count()
    hist = partition.histogram(keys, 2)
    assert hist.agg(F.sum("n")).first()[0] == valid
    off = partition.offsets(hist).orderBy("bank", "dst_bank").collect()
    total, bank = 0, None
    for r in off:
        total = 0 if r["bank"] != bank else total
        assert r["offset"] == total
        total, bank = total + r["n"], r["bank"]
    slots = partition.slots(keys, 2).collect()
    runs = {}
    for r in slots:
        runs.setdefault((r["bank"], r["dst_bank"]), []).append(r["slot"])
        assert r["packet_no"] == r["slot"] // 2
    assert len(slots) == valid and all(sorted(v) == list(range(len(v))) for v in runs.values())
    assert partition.exchange(keys, 2).agg(F.sum("n_rows")).first()[0] == valid
    assert partition.local_histogram(keys, 2, 20).agg(F.sum("n")).first()[0] == valid
    with pytest.raises(ValueError):
        partition.slots(keys, 2, 24)


def test_fan_out(spark):
    df = spark.createDataFrame([(1934,), (1935,), (3870,), (7740,), (11721,)], "n long").select(partition.fan_out(F.col("n")))
    assert [r[0] for r in df.collect()] == [1, 2, 4, 8, 8]


def test_sorts(spark):
    df = spark.createDataFrame([(5, 1), (5, 0), (-3, 2), (9, 9), (5, 1)], "lvalue long, rvalue long")
    for a in (*sorts.ALGORITHMS, "other"):
        assert [tuple(r) for r in sorts.sort(df, a).orderBy("pos").select("lvalue", "rvalue").collect()] == [(-3, 2), (5, 0), (5, 1), (5, 1), (9, 9)]
    assert sorts.bucket_histogram(spark.createDataFrame([(4, 1)] * 1000, "lvalue long, rvalue long")).agg(F.sum("n")).first()[0] == 1000
    assert sorts.bucket_histogram(df.limit(0)).count() == 0
    words = spark.createDataFrame([("b", 1), ("a", 2), ("ab", 3), ("é", 4)], "w string, t long")
    assert [r[0] for r in sorts.sort_tids(words, "w", "t").orderBy("pos").select("tid").collect()] == [2, 3, 1, 4]
    assert [r[0] for r in sorts.sort_tids(words, "w", "t", False).orderBy("pos").select("tid").collect()] == [4, 1, 3, 2]
    assert numbered(words.limit(0), ["t"]).count() == 0


def test_selections(spark):
    df = spark.createDataFrame([(1, "FO"), (2, "F"), (3, "X")], "k long, s string")
    k = F.col("k")
    got = lambda c: [r[0] for r in df.where(c).collect()]
    assert [got(selections.compare(k, c, 2, True)) for c in range(5)] == [[2], [1, 2], [2, 3], [1], [3]]
    assert got(selections.compare(k, 0, 2)) == [3]
    assert got(selections.between(k, 1, 3, True)) == [2] and got(selections.between(k, 1, 3)) == [1, 2, 3]
    assert got(selections.contains(F.col("s"), "O")) == [1] and got(selections.is_prefix_of(F.col("s"), "FO")) == [1, 2]
    with pytest.raises(ValueError):
        selections.is_in(k, list(range(9)))
    assert sorted(r["code"] for r in selections.encode(df, "s").collect()) == [0, 1, 2]
    assert selections.either(df.where("k < 3").select("k"), df.where("k > 1").select("k")).count() == 3


def test_projections(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert df.select(projections.postfix(["a", "b", "ADD", 2, "MUL", 4, "DIV"])).first()[0] == 2.5
    for bad in (["a", "ADD"], ["a", "b"], ["a"] * 11):
        with pytest.raises(ValueError):
            projections.postfix(bad)


def test_groups(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 7)], "k long, v long")
    assert sorted(tuple(r) for r in aggregates.group_by(df, ["k"], "v").collect()) == [(1, 1, 5, 5, 5), (2, 1, 7, 7, 7)]
    with pytest.raises(ValueError):
        aggregates.group_by(df, ["a", "b", "c", "d"], "v")


def test_plan_errors(spark):
    t = {"left": spark.createDataFrame([(1, 2)], "lvalue long, rvalue long")}
    for steps in ([{"operator": "nonzero", "inputs": ["none"]}], [{"operator": "none", "inputs": ["left"]}], [{"operator": "nonzero", "inputs": ["left"], "output": "left"}], []):
        with pytest.raises(PlanError):
            run_plan(steps, t)


def test_pushdown(spark, tmp_path):
    from kvjoin.operators.joins import join
    from kvjoin.relation import load_column

    spark.range(100).selectExpr("id AS a", "id AS b", "id AS c").write.parquet(f"{tmp_path}/t.parquet")
    r = load_column(spark, f"{tmp_path}/t.parquet", "a", "b")
    plan = join(r, r, "smj")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(a)" in plan and "ReadSchema: struct<a:bigint,b:bigint>" in plan


def test_numbered_parts_the_order_evenly(spark):
    """Strings with a long common beginning and a heavy value in the leading column: no bucket has far more rows than others."""
    names = spark.range(20000).selectExpr("concat('Customer#000', lpad(string(id * 7919 % 20000), 9, '0')) AS t", "id")
    heavy = spark.range(20000).selectExpr("IF(id % 3 = 0, 5, id % 50) AS t", "id")
    mixed = spark.range(3000).selectExpr("IF(id % 5 = 0, NULL, concat('it''s ', char(92), string(id % 40))) AS t", "id")
    for df in (names, heavy, mixed):
        for order in (["t", "id"], ["-t", "id"]):
            cuts = bounds(df, order, 32)
            sizes = [r["count"] for r in df.groupBy(bucket(df, order, cuts).alias("b")).count().collect()]
            assert len(sizes) == 32 and max(sizes) < 2 * df.count() / 32
            keys = [F.col("t").desc() if order[0] == "-t" else F.col("t"), F.col("id")]
            got = [r["id"] for r in numbered(df, order).orderBy("pos").collect()]
            assert got == [r["id"] for r in df.orderBy(*keys).collect()]
    assert numbered(names, ["t", "id"]).agg(F.countDistinct("pos"), F.min("pos"), F.max("pos")).first()[:] == (20000, 0, 19999)


def test_buckets_by_brute_force(spark):
    """Nulls first going up and last going down, quotes in strings, times, fewer cuts than a power of two, none at all."""
    import datetime

    rng = random.Random(8)
    day = datetime.datetime(2020, 1, 1, 12, 30, 0, 5)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a'b", 'q"\\', "é", ""]), rng.choice([None, day, day + datetime.timedelta(days=1)]), rng.choice([None, -1.5, 0.1, 7.25])) for _ in range(200)]
    df = spark.createDataFrame(rows, "`a.b` long, s string, t timestamp, f double").withColumnRenamed("a.b", "k").repartition(3)
    for order in (["k", "s"], ["-k", "s", "-t"], ["-s"], ["t", "-f", "k"], ["f"]):
        names = ["k", "s", "t", "f"]
        for n in (1, 2, 6, 40):
            cuts = bounds(df, order, n)
            got = with_bucket(df, order, cuts, "b").withColumn("c", bucket(df, order, cuts)).collect()
            assert all(r["b"] == r["c"] for r in got) and (n == 1) <= ({r["b"] for r in got} == {0})

            def place(r):
                out = []
                for x in order:
                    v = r[names.index(x.removeprefix("-"))]
                    v = (0,) if v is None else (1, v.encode() if isinstance(v, str) else v)
                    out.append(Down(v) if x.startswith("-") else v)
                return out

            ranked = sorted(got, key=place)
            assert [r["b"] for r in ranked] == sorted(r["b"] for r in got)
            for a, b in zip(ranked, ranked[1:]):
                assert a["b"] == b["b"] or place(a) < place(b)


class Down:
    def __init__(self, v):
        self.v = v

    def __lt__(self, other):
        return other.v < self.v

    def __eq__(self, other):
        return self.v == other.v
