"""Probing a static build side with a stream: each micro-batch is joined as it comes, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvjoin.relation import valid_key


def probe_stream(build: DataFrame, stream: DataFrame, reserved: int | None = 0) -> DataFrame:
    """(lvalue, rvalue) for each row of the stream (lvalue, rvalue) and each build row of the same valid key."""
    r = build.where(valid_key(F.col("lvalue"), reserved)).select(F.col("lvalue").alias("rk"), F.col("rvalue").alias("rv"))
    s = stream.where(valid_key(F.col("lvalue"), reserved)).select(F.col("lvalue").alias("sk"), F.col("rvalue").alias("sv"))
    return s.join(r, F.col("rk") == F.col("sk")).select(F.col("rv").alias("lvalue"), F.col("sv").alias("rvalue"))


def run_probe(build: DataFrame, stream: DataFrame, out: str, reserved: int | None = 0) -> DataFrame:
    """Probe with all that the stream has now, into Parquet files at out (each batch exactly once, whatever executors are lost), and the result."""
    held = probe_stream(build, stream, reserved)
    held.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    return build.sparkSession.read.schema(held.schema).parquet(out)
