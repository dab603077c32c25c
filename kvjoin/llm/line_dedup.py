"""Line dedup by winnowing over line hashes.

Each document is a sequence of counted lines (lines with a character other than
space, tab or carriage return; compared without those at their ends). Of every
window of min_run consecutive line hashes the minimum is a fingerprint, so any
run of at least min_run lines that two places share has a common fingerprint.
Fingerprints that occur twice are joined with their positions and extended both
ways to every window of min_run lines around them; equal windows meet, and all
but the first, by (doc_id, hash of the text, position), are later repeats. Their
union is the later repeated runs, whose lines are deleted.

No pair of occurrences is ever made: a window only meets the first of its kind.
Line and window hashes are two seeded 64-bit hashes together. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, hot_join, let, materialize, same, table, texts

MIN_RUN = 3
BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trimmed(text: Column) -> Column:
    return F.transform(_lines(text), lambda x: F.btrim(x, F.lit(BLANK)))


def fingerprints(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, th, f1, f2, windows): a row per fingerprint; windows holds (at, w1, w2) of the windows of min_run lines that contain it."""
    n = min_run

    def found(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v["h"]) - n + 1)
        w = F.transform(starts, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(v["h"], i, n)).alias("w1"), F.xxhash64(F.lit(2), F.slice(v["g"], i, n)).alias("w2")))
        # The last minimum of a window, so that equal windows pick the same line.
        low = F.transform(starts, lambda i: let(F.slice(v["h"], i, n), lambda x: i + n - F.array_position(F.reverse(x), F.array_min(x)).cast("int")))

        def row(at: Column, w: Column) -> Column:
            first = F.greatest(F.lit(1), at - n + 1)
            return F.struct(F.element_at(v["h"], at).alias("f1"), F.element_at(v["g"], at).alias("f2"), F.slice(w, first, at - first + 1).alias("windows"))

        return let(w, lambda w: F.transform(F.array_distinct(low), lambda at: row(at, w)))

    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.array_remove(_trimmed(F.col("text")), "").alias("ls")).where(F.size("ls") >= n)
    both = F.struct(F.transform("ls", lambda x: F.xxhash64(x)).alias("h"), F.transform("ls", lambda x: F.xxhash64(F.lit(1), x)).alias("g"))
    return d.select("doc_id", "th", F.inline(let(both, found)))


def repeats(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, th, starts): for each document with later repeated runs, where their windows start among its counted lines, from 1."""
    prints = fingerprints(docs, min_run)
    twice = prints.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    around = hot_join(prints, twice, ["f1", "f2"]).select("doc_id", "th", F.inline("windows"))
    around = materialize(around)
    me = F.struct("doc_id", "th", "at")
    first = around.groupBy("w1", "w2").agg(F.min(me).alias("first"), F.max(me).alias("last")).where(F.col("last") > F.col("first")).drop("last")
    later = hot_join(around, first, ["w1", "w2"]).where(me > F.col("first"))
    return later.groupBy("doc_id", "th").agg(F.collect_set("at").alias("starts"))


def _with_kept(docs: DataFrame, min_run: int, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with two columns more: the kept lines (null where nothing was removed) and the number of removed lines; and their names."""
    found = repeats(texts(docs, id_col, text_col), min_run)
    d, h, s = (fresh(docs, x) for x in ("dup_doc", "dup_text", "dup_starts"))
    found = found.select(F.col("doc_id").alias(d), F.col("th").alias(h), F.col("starts").alias(s))
    joined = docs.join(found, same(F.col(id_col), F.col(d)) & (F.xxhash64(F.col(text_col)) == F.col(h)), "left").drop(d, h)
    gone = F.sort_array(F.array_distinct(F.flatten(F.transform(s, lambda x: F.sequence(x, x + min_run - 1)))))
    r = fresh(docs, "dup_gone")
    joined = joined.withColumn(r, F.when(F.col(s).isNotNull(), gone))

    def rest(v: Column) -> Column:
        """The lines between the removed ones, as pieces; places: of the counted lines among all."""
        places = F.filter(F.transform(v["lines"], lambda x, i: F.when(F.btrim(x, F.lit(BLANK)) != "", i + 1)), lambda i: i.isNotNull())
        at = let(places, lambda places: F.transform(v["gone"], lambda p: F.element_at(places, p)))
        cuts = F.concat(F.array(F.lit(0)), at, F.array(F.size(v["lines"]) + 1))
        piece = lambda c, i: let(F.element_at(c, i), lambda a: F.slice(v["lines"], a + 1, F.element_at(c, i + 1) - a - 1))
        return let(cuts, lambda c: F.flatten(F.transform(F.sequence(F.lit(1), F.size(v["gone"]) + 1), lambda i: piece(c, i))))

    kept, n = fresh(docs, "dup_kept"), fresh(docs, "dup_n")
    both = F.struct(_lines(F.col(text_col)).alias("lines"), F.col(r).alias("gone"))
    joined = joined.withColumn(kept, F.when(F.col(r).isNotNull(), let(both, rest)))
    joined = joined.withColumn(n, F.coalesce(F.size(F.col(r)), F.lit(0)).cast("long"))
    return joined.select(*docs.columns, kept, n), kept, n


def dedup(docs: DataFrame, min_run: int = MIN_RUN, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """docs, all columns, with the lines of later repeated runs deleted from the text.

    A run is min_run counted lines or more. Of equal windows the one with the smallest doc_id (then
    hash of the text, then position) stays; a null id comes before all others. Windows are judged on
    the input, so of one line over and over only the first is left. Rows equal in id and text count as one document and get the same text. Blank lines and texts
    of fewer counted lines stay, null stays null. Work grows with the number of lines of a text, also of a very long one. drop_emptied leaves out documents that lost every
    counted line. An empty table gives an empty one; other columns pass through whatever their names.
    """
    joined, kept, n = _with_kept(docs, min_run, id_col, text_col)
    out = joined
    if drop_emptied:
        out = out.where(F.col(kept).isNull() | F.exists(F.col(kept), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    text = F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def report(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """One row per document: doc_id, n_lines (counted), n_removed, kept_sha256 (of the text that dedup() gives; null counts as empty).

    Null ids, repeated rows and long texts as in dedup(). An empty table gives an empty one; only doc_id and text are read.
    """
    docs = texts(docs)
    joined, kept, n = _with_kept(docs, min_run, "doc_id", "text")
    text = F.when(F.col(kept).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        "doc_id",
        F.size(F.array_remove(_trimmed(F.col("text")), "")).cast("long").alias("n_lines"),
        F.col(n).alias("n_removed"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH l AS (SELECT doc_id, i, x, trim(x, ' ' || chr(9) || chr(13)) AS t
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), LATERAL (SELECT unnest(generate_series(1, len(ls))) AS i), LATERAL (SELECT ls[i] AS x)),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, count(*) OVER (PARTITION BY doc_id) AS m FROM l WHERE t <> ''),
w AS (SELECT doc_id, p, string_agg(t, chr(10)) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {MIN_RUN - 1} FOLLOWING) AS s, m FROM c),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w WHERE p <= m - {MIN_RUN - 1}),
g AS (SELECT DISTINCT doc_id, p + j AS p FROM f, (SELECT unnest(range({MIN_RUN})) AS j) WHERE k > 1),
k AS (SELECT l.doc_id, l.i, l.x, c.p, g.p AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i LEFT JOIN g ON c.doc_id = g.doc_id AND c.p = g.p)
SELECT doc_id, count(p) AS n_lines, count(gone) AS n_removed, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
