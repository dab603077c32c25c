import pytest

from kvjoin.operators.joins import join
from kvjoin.sources import tables
from kvjoin.streaming.probe import probe_stream

SCHEMA = "lvalue long, rvalue long"


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 2), (3, 4)], "k long, v int")
    for kind in tables.FORMATS:
        df.write.format(kind).save(f"{tmp_path}/{kind}")
        got = tables.read_relation(spark, f"{tmp_path}/{kind}", "k", "v", kind, "k long, v int")
        assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 4)] and got.dtypes == [("lvalue", "bigint"), ("rvalue", "bigint")]
    with pytest.raises(ValueError):
        tables.read_relation(spark, "x", "k", "v", "csv")
    with pytest.raises(ValueError):
        tables.read_relation(spark, "x", "k", "v", "xml")


def test_named_blocks(spark):
    df = spark.createDataFrame([(1, 2)], SCHEMA)
    tables.store(df, "block_a")
    with pytest.raises(ValueError):
        tables.store(df, "block_a")
    assert tables.retrieve(spark, "block_a").count() == 1
    tables.free(spark, "block_a")
    tables.store(df, "block_a")
    tables.free(spark, "block_a")


def test_bucketed_join_has_no_exchange(spark):
    df = spark.range(1, 500).selectExpr("id AS lvalue", "id AS rvalue")
    a, b = (tables.write_bucketed(df, f"bucketed_{x}", 4) for x in "ab")
    out = join(a, b, "smj")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.count() == 499
    for x in "ab":
        spark.sql(f"DROP TABLE bucketed_{x}")


def test_probe_stream(spark, tmp_path):
    spark.createDataFrame([(1, 10), (0, 11), (2, 12), (1, 13)], SCHEMA).write.parquet(f"{tmp_path}/in")
    build = spark.createDataFrame([(1, 5), (0, 6)], SCHEMA)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    q = probe_stream(build, stream).writeStream.format("memory").queryName("probed").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("probed").collect())) == [(5, 10), (5, 13)]
