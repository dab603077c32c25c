"""Edge relations and invariants of the joins."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from kvjoin import catalog
from kvjoin.operators import joins, probing
from kvjoin.plans.steps import run_plan
from kvjoin.relation import checked, nonzero, padding, violations

SCHEMA = "lvalue long, rvalue long"


def rel(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute(left, right):
    return sorted((v, w) for k, v in left for j, w in right if k is not None and k == j and 0 < k < 2**31)


CASES = {
    "empty": ([], []),
    "single": ([(1, 10)], [(1, 20)]),
    "zero_key": ([(0, 1), (1, 2)], [(0, 3), (1, 4)]),
    "zero_payload": ([(5, 0)], [(5, 0)]),
    "max_key": ([(2**31 - 1, 1)], [(2**31 - 1, 2)]),
    "bad_key": ([(2**31, 1), (2**32 - 1, 2), (-1, 3)], [(2**31, 1), (-1, 3)]),
    "dup_build": ([(7, 1), (7, 2)], [(7, 9)]),
    "dup_probe": ([(7, 1)], [(7, 8), (7, 9)]),
    "disjoint": ([(1, 1)], [(2, 2)]),
    "gap": ([(1, 1), (3, 3)], [(1, 1), (2, 2), (3, 3)]),
    "null_key": ([(None, 1), (2, 2)], [(None, 1), (2, 5)]),
}


@pytest.mark.parametrize("case", CASES)
def test_edges(spark, case):
    left, right = CASES[case]
    for a in joins.ALGORITHMS if case in ("gap", "zero_key") else ("phj", "smj"):
        assert rows(joins.join(rel(spark, *left), rel(spark, *right), a)) == brute(left, right), a


def test_algorithms_agree_on_skew(spark):
    rng = random.Random(7)
    left = [(k, rng.randrange(100)) for k in range(200)]
    right = [(3 if rng.random() < 0.9 else rng.randrange(300), i) for i in range(2000)]
    want = brute(left, right)
    for a in joins.ALGORITHMS:
        assert rows(joins.join(rel(spark, *left), rel(spark, *right), a)) == want, a


@pytest.mark.parametrize("algorithm,node", [("phj", "ShuffledHashJoin"), ("smj", "SortMergeJoin"), ("nphj", "BroadcastHashJoin"), ("nl", "CartesianProduct"), ("mpsm", "SortMergeJoin")])
def test_plan_has_the_algorithm(spark, algorithm, node):
    a = spark.range(1, 100).selectExpr("id AS lvalue", "id + 2 AS rvalue")
    df = joins.join(a, a, algorithm)
    assert node in df._jdf.queryExecution().executedPlan().toString()
    assert df.where("lvalue <> rvalue").isEmpty() and df.count() == 99


def test_strict(spark):
    with pytest.raises(joins.DuplicateKeyError):
        joins.join(rel(spark, (7, 1), (7, 2)), rel(spark, (7, 9)), strict=True)
    with pytest.raises(Exception, match="key out of the domain"):
        checked(rel(spark, (2**31, 1))).collect()
    assert rows(checked(rel(spark, (0, 1), (4, 2)))) == [(4, 2)]
    with pytest.raises(ValueError):
        joins.join(rel(spark), rel(spark), "other")


def test_probe_invariant(spark):
    left, right = rel(spark, (1, 1), (1, 2), (4, 4)), rel(spark, (1, 5), (2, 6), (0, 7), (4, 8))
    p, h, u = joins.probe_stats(left, right).first()
    assert (p, h, u) == (3, 2, 1) and h + u == nonzero(right).count()
    assert rows(joins.in_place(left.where("lvalue = 4"), right)) == [(1, 5), (2, 6), (4, 8)]


def test_finish_and_violations(spark):
    assert rows(joins.finish(rel(spark, (0, 0), (0, 3), (4, 0)))) == [(0, 3), (4, 0)]
    got = {r["lvalue"]: r["reason"] for r in violations(rel(spark, (0, 1), (-1, 1), (2**31, 1), (None, 1), (5, 1))).collect()}
    assert got == {0: "reserved", -1: "negative", 2**31: "too large", None: "null"}


def test_finish_keeps_zeros_and_nulls_of_the_result(spark):
    """Only padding goes, not pairs of zeros that matched, copies of them, or rows with a null."""
    held = [(0, 0), (0, 0), (0, 3), (None, 0), (0, None), (None, None)]
    for n in (0, 1, 64):
        dump = joins.padded(rel(spark, *held), n)
        assert dump.count() == len(held) + n
        assert Counter(map(tuple, joins.finish(dump).collect())) == Counter(held)
    plan = [{"operator": "pad", "inputs": ["j"], "output": "p", "tuples": 5}, {"operator": "finish", "inputs": ["p"]}]
    assert Counter(map(tuple, run_plan(plan, {"j": rel(spark, *held)}).collect())) == Counter(held)
    assert Counter(map(tuple, joins.finish(rel(spark, *held)).collect())) == Counter(held[2:])  # a bare dump


def test_finish_join_is_its_sql_on_zeros_and_nulls(spark, tmp_path):
    """Customer 0 in a nation of region 0, keys that are null, a nation without a region."""
    nation, customer = [(0, 0), (5, 0), (6, None), (None, 0)], [(0, 5), (0, 5), (0, 0), (1, 5), (None, 5), (0, 6), (None, 6), (2, None), (3, 7)]
    spark.createDataFrame(nation, "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame(customer, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in ("nation", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = Counter(con.sql(catalog.oracle_sql()["finish_join"]).fetchall())
    assert want == Counter([(0, 0), (0, 0), (0, 1), (0, None), (None, 0), (None, None)])
    assert Counter(map(tuple, catalog.queries()["finish_join"](spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("n,ranks,want", [(12002342, 16, (986, 11722)), (52428800, 1, (64, 819201)), (33554432, 16, (1024, 32769)), (2352363, 2, (21, 18378)), (200000, 1, (64, 3126)), (15000, 1, (40, 235))])
def test_padding(n, ranks, want):
    assert padding(n, ranks) == want


def test_instance(spark):
    j = joins.JoinInstance(spark, 4)
    with pytest.raises(ValueError):
        j.join()
    j.load("left", rel(spark, (1, 3)))
    j.load("right", rel(spark, (1, 4)))
    with pytest.raises(ValueError):
        j.load("left", rel(spark, (1, 3)))
    with pytest.raises(ValueError):
        j.load("middle", rel(spark, (1, 3)))
    assert rows(j.join("smj")) == [(3, 4)]


def test_generated_relation(spark):
    a = spark.range(20000).select((F.col("id") + 1).alias("lvalue"), (F.col("id") + 3).alias("rvalue"))
    df = joins.join(a, a)
    assert df.count() == 20000 and df.where("lvalue <> rvalue").count() == 0


def test_mpsm_keeps_its_ranges(spark):
    """Both sides are dealt out once, by ranges that the build keys gave; equal keys are in the same range."""
    build = spark.range(1, 5001).selectExpr("id * 7 AS lvalue", "id AS rvalue")
    probe = spark.range(0, 20000).selectExpr("id % 40000 AS lvalue", "id AS rvalue")
    out = joins.join(build, probe, "mpsm")
    assert out.count() == joins.join(build, probe, "smj").count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "ENSURE_REQUIREMENTS" not in plan and plan.count("Exchange hashpartitioning(") == 2
    assert "hashpartitioning(rb" in plan and "hashpartitioning(sb" in plan
    r, s = joins.ranges(build.selectExpr("lvalue AS rk"), probe.selectExpr("lvalue AS sk"))
    per = r.groupBy("rb").agg(F.min("rk"), F.max("rk"), F.count(F.lit(1))).orderBy("rb").collect()
    assert len(per) > 1 and all(a[2] < b[1] for a, b in zip(per, per[1:]))
    assert r.join(s, F.col("rk") == F.col("sk")).where("rb <> sb").count() == 0


def test_free_of_an_unknown_relation(spark):
    with pytest.raises(ValueError):
        joins.JoinInstance(spark).free("left")


def brute_table(keyed, size):
    """Insert as probing.slots orders keys: {slot: key}, by walking the ring."""
    at = {}
    for home, key in sorted(keyed):
        while home in at:
            home = (home + 1) % size
        at[home] = key
    return at


@pytest.mark.parametrize("n", [3, 1500, 3900])
def test_linear_probing(spark, n):
    """Against a table walked slot by slot. What is taken and all probes together don't depend on the order of insertion."""
    build = spark.range(1, 3 * n, 3).selectExpr("id AS lvalue", "id AS rvalue").union(spark.createDataFrame([(0, 1), (None, 2), (1, 3)], "lvalue long, rvalue long"))
    probe = spark.createDataFrame([(k, k) for k in (1, 1, 2, 4, 5, 0, 999_999, 123_457, 4096, 8192)], "lvalue long, rvalue long").union(spark.range(3 * n).selectExpr("id", "id"))
    got = probing.slots(build, 1).collect()
    table = brute_table([(r["home"], r["lvalue"]) for r in got], probing.SLOTS)
    assert len(got) == n and {r["slot"] for r in got} == set(table)
    assert sum(r["extra"] for r in got) == sum((s - {r["lvalue"]: r["home"] for r in got}[k]) % probing.SLOTS for s, k in table.items())
    hits = misses = extra = 0
    keys = {r["lvalue"]: r["extra"] for r in got}
    asked = [(r["lvalue"], r["home"]) for r in probing.homes(probe, 1).collect()]
    for key, home in asked:
        if key in keys:
            hits += keys[key]
            continue
        misses += 1
        while home in table:
            home, extra = (home + 1) % probing.SLOTS, extra + 1
    row = probing.probes(build, probe, 1).first()
    assert (row["probed"], row["hits"], row["hit_extra"], row["empty"], row["empty_extra"]) == (len(asked), len(asked) - misses, hits, misses, extra)


def test_linear_probing_limits(spark):
    none = spark.range(0).selectExpr("id AS lvalue", "id AS rvalue")
    some = spark.range(1, 6).selectExpr("id AS lvalue", "id AS rvalue")
    assert probing.slots(none, 1).count() == 0 and probing.probes(some, none, 1).count() == 0
    assert probing.probes(none, some, 1).first()["empty"] == 5
    with pytest.raises(Exception, match="no empty slot"):
        probing.slots(spark.range(1, probing.SLOTS + 1).selectExpr("id AS lvalue"), 1).collect()
    assert [probing.tables_for(n) for n in (0, 1934, 1935, 3870)] == [1, 1, 2, 4]


def test_theta_beyond_the_broadcast(spark, monkeypatch):
    a = spark.range(1, 40).selectExpr("id AS lvalue", "id AS rvalue")
    want = sorted(map(tuple, joins.theta(a, a, "rk < sk").collect()))
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, joins.theta(a, a, "rk < sk").collect())) == want and len(want) == 39 * 38 // 2
