"""Reading and writing relations: files, named views, bucketed tables for co-located joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kvjoin.relation import relation

FORMATS = ("parquet", "orc", "csv", "json")


def read_relation(spark: SparkSession, path: str, key: str, payload: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """(lvalue, rvalue) of two columns of a file source; text formats need a schema, so that nothing is read twice to infer one."""
    if kind not in FORMATS:
        raise ValueError(f"format: {kind}")
    reader = spark.read.format(kind)
    if kind in ("csv", "json"):
        if not schema:
            raise ValueError(f"{kind} needs a schema")
        reader = reader.schema(schema)
    return relation(reader.load(path), key, payload)


def store(df: DataFrame, name: str) -> None:
    """Name a block for later steps; a name can be taken once."""
    spark = df.sparkSession
    if spark.catalog.tableExists(name):
        raise ValueError(f"{name} exists")
    df.createTempView(name)


def retrieve(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def free(spark: SparkSession, name: str) -> None:
    spark.catalog.dropTempView(name)


def shared_path(spark: SparkSession, stem: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all executors share; in local mode without that setting, in a temp folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kvjoin-")
    return f"{at}/{stem}_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "lvalue", path: str | None = None) -> DataFrame:
    """Save df as a table bucketed and sorted by key: joins of tables with as many buckets need no exchange. path: where its files go, else the warehouse."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return df.sparkSession.table(table)
