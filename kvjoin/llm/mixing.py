"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, weight * total / rows. A document's
count inverts that source's Poisson distribution at a uniform number that is a
hash of its id, so equal inputs give equal mixtures on any cluster. Documents are
exploded by their counts and dealt out by a hash of (id, copy): a global shuffle
without a sampling pass. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table

#: The source table is broadcast while it has at most so many CDF entries (8 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ENTRIES = 500_000
ALPHA = 0.5
SEED = "mix-1"
DIGITS = 12  # hex digits of the hash: 48 bits, exact in a double


def _uniform(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, alpha: float, total: float | None) -> tuple[DataFrame, int]:
    """(source, n_rows, rate) for each source, and a bound for the entries of all CDFs. Two scalars and a bound come to the driver."""
    per = docs.groupBy(F.col(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        per = per.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        per = per.withColumn("w", F.coalesce(F.try_element_at(known, F.col("s")).cast("double"), F.lit(0.0)) if weights else F.lit(0.0))
    sums = per.agg(F.sum("n"), F.sum("w"), F.count(F.lit(1)), F.max(F.col("w") / F.col("n"))).first()
    rows, mass, sources, steepest = (sums[0] or 0, sums[1] or 0.0, sums[2], sums[3] or 0.0)
    scale = (float(total) if total is not None else float(rows)) / mass if mass > 0 else 0.0
    most = scale * steepest
    entries = int(sources * (most + 12 * most**0.5 + 32))
    return per.select("s", "n", (F.col("w") * F.lit(scale) / F.col("n")).alias("rate")), entries


def quantiles(per: DataFrame) -> DataFrame:
    """cdf: the Poisson distribution function at 0, 1, 2, ...; pmf in logarithms, so that large rates don't underflow."""
    w = Window.partitionBy("s").orderBy("k")
    steps = per.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int"))))
    steps = steps.where("rate > 0").withColumn("step", F.when(F.col("k") == 0, -F.col("rate")).otherwise(F.log(F.col("rate") / F.col("k"))))
    steps = steps.withColumn("pmf", F.exp(F.sum("step").over(w))).withColumn("cdf", F.sum("pmf").over(w))
    return steps.groupBy("s").agg(F.first("rate").alias("rate"), F.sort_array(F.collect_list("cdf")).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = ALPHA,
    total: float | None = None,
    seed: str = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    details: bool = False,
) -> DataFrame:
    """docs, each row as often as its count says, in shuffled order; details adds rate, n_copies, copy_no and shuffle_key.

    weights: target weight by source, a source not named gets 0; None takes rows ** alpha.
    total: expected number of rows of the mixture, by default that of docs.

    A null source is a source of its own (with weights given, of weight 0). Rows with a null
    id share the hash of the empty string, and rows with equal ids their count. Null or empty
    texts are mixed like others, and very long ones, which only pass through. An empty table gives an empty one. Clashing column names are kept.
    """
    per, entries = rates(docs, source_col, weights, alpha, total)
    q = quantiles(per).select(F.col("s").alias(s := fresh(docs, "mix_source")), F.col("rate").alias(r := fresh(docs, "mix_rate")), F.col("cdf").alias(c := fresh(docs, "mix_cdf")))
    if entries <= BROADCAST_ENTRIES:
        q = F.broadcast(q)
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    joined = docs.join(q, F.col(source_col).eqNullSafe(F.col(s)))
    joined = joined.withColumn(u := fresh(docs, "mix_u"), _uniform(F.lit(seed), name))
    joined = joined.withColumn(n := fresh(docs, "mix_n"), F.size(F.filter(c, lambda x: x <= F.col(u))))
    copies = joined.withColumn(j := fresh(docs, "mix_copy"), F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>"))))
    copies = copies.withColumn(k := fresh(docs, "mix_key"), F.md5(F.concat_ws("|", F.lit(seed), name, F.col(j).cast("string")).cast("binary")))
    copies = copies.drop(s, c, u).repartition(F.col(k)).sortWithinPartitions(k)
    if not details:
        return copies.select(*docs.columns)
    return copies.select(*docs.columns, F.col(r).alias("rate"), F.col(n).cast("long").alias("n_copies"), F.col(j).cast("long").alias("copy_no"), F.col(k).alias("shuffle_key"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, details=True).drop("rate")


ORACLE = f"""
WITH per AS (SELECT source AS s, count(*) AS n, pow(count(*)::DOUBLE, {ALPHA}) AS w FROM documents GROUP BY source),
sums AS (SELECT sum(n)::DOUBLE AS rows, sum(w) AS mass FROM per),
r AS (SELECT s, w * (rows / mass) / n AS rate FROM per, sums),
steps AS (SELECT s, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS pmf FROM r, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k)),
q AS (SELECT s, k, sum(pmf) OVER (PARTITION BY s ORDER BY k) AS cdf FROM steps),
d AS (SELECT doc_id, text, source, ('0x' || substr(md5('{SEED}|' || doc_id::VARCHAR), 1, {DIGITS}))::BIGINT / {16**DIGITS}::DOUBLE AS u FROM documents),
c AS (SELECT doc_id, any_value(text) AS text, any_value(source) AS source, count(*) AS n FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.s AND q.cdf <= d.u GROUP BY doc_id)
SELECT doc_id, text, source, n AS n_copies, copy_no, md5('{SEED}|' || doc_id::VARCHAR || '|' || copy_no::VARCHAR) AS shuffle_key
FROM c, LATERAL (SELECT unnest(generate_series(1, n)) AS copy_no)
"""
