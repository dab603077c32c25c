"""What the operators share: reading tables, names that clash with nothing, working folders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator needs, as (doc_id, text); other columns can't clash after this."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    have = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in have:
        name = f"_{name}"
    return name


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), in which value is computed once however often f, or a function over an array within f, refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or a temp folder of this machine where it is unset (local mode, tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kvjoin-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and losing executors loses nothing."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/kvjoin-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() returned; nothing may read them afterwards."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys, for a left side on which some keys have very many rows and a right side with one row per key.

    The hash of the keys is one more key. So both sides are shuffled for this join and no earlier
    partitioning is taken over, which is what lets adaptive execution split a hot key's rows.
    """
    extra = fresh(left, "spread")
    a = left.withColumn(extra, F.xxhash64(*keys))
    b = right.withColumn(extra, F.xxhash64(*keys))
    return a.join(b, [extra, *keys], how).drop(extra)
