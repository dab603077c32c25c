"""From documents to a training mixture: language ID, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet to the shared folder and reads it again as the next
stage's docs, so a lost executor costs one stage's tasks at most. All stages but
the last return the columns of documents, with whatever other columns docs has.

For every stage: null ids and repeated rows are documents like others unless the stage says otherwise, an
empty table gives an empty one, texts are read whole however long, and results don't depend on
the order or the partitions of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvjoin.llm import decontaminate, language, line_dedup, mixing, near_dedup
from kvjoin.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are und (null, empty, without a letter) or score below language.MIN_SCORE go. The model learns from docs; without any lang all are und and go."""
    return language.keep_identified(docs, language.fit(*language.sample(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go; documents that lost every line go too. n_chars follows the text. Null texts stay null; rows equal in id and text get the same text; a null id comes before all others."""
    out = line_dedup.dedup(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: that with the smallest id, a null id after all others, one row of it. Texts without words are no copies and stay."""
    return near_dedup.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go. Null and empty texts have none and stay; so does everything if the benchmark is empty."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights (rows ** mixing.ALPHA): columns of documents and n_copies, copy_no, shuffle_key. A null source is a source of its own; rows with equal ids, or null ones, share their count."""
    return mixing.mix(docs, details=True).drop("rate")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: Language ID and near-dedup can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return materialize(STAGES[-1][1](spark, docs, sf_dir))
