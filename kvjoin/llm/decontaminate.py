"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, matched against every window of the training tokens.

The benchmark's windows are hashed (xxhash64 of their words) and broadcast while
their number is proven small. Each document's words are exploded by position; the
window's hash is computed, looked up and, on a hit, verified word for word within
one code-generated stage, so a position that hits nothing never leaves it. Each
document keeps its first position as a marker, so one aggregation by document
yields the counts of all documents, hit or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, same, table, texts

N = 10
#: Windows are broadcast while there are at most so many (about 200 bytes each), beyond that their hashes alone (about 40 bytes each); with more hashes than that, the documents' hashes are shuffled. Results are the same.
BROADCAST_WINDOWS, BROADCAST_HASHES = 400_000, 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text after lower-casing A-Z alone; null has none. Texts of ASCII letters alone take the fast path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), "")


def windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w_len, w_text, w_items): distinct windows with the ids, as strings, of the items that have them; an item of fewer than n words is one window."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("ws")).where(F.size("ws") > 0)
    items = items.withColumn("w_len", F.least(F.size("ws"), F.lit(n)))
    each = items.select("item", "w_len", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("w_len") + 1)).alias("at"))
    each = each.select("item", "w_len", F.array_join(F.slice("ws", F.col("at"), F.col("w_len")), " ").alias("w_text"))
    return each.groupBy("w_len", "w_text").agg(F.sort_array(F.collect_set("item")).alias("w_items"))


def _hash(ws: Column, at: Column, length: int) -> Column:
    """Hash of the words at positions at .. at + length - 1; null, which joins with nothing, where the document ends before."""
    return F.when(at + length <= F.size(ws), F.xxhash64(F.lit(length), *[F.get(ws, at + k) for k in range(length)]))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, th (hash of the text), n_rows, n_words, hits (array of (at, len, items)).

    docs: as from texts().
    """
    win = windows(benchmark, n)
    sizes = {r[0]: r[1] for r in win.groupBy("w_len").count().collect()}  # n rows at most
    lengths = sorted(sizes, reverse=True) or [n]
    win = win.withColumn("ws", F.split("w_text", " "))
    key = F.lit(None).cast("long")
    for length in lengths:
        key = F.when(F.col("w_len") == length, _hash(F.col("ws"), F.lit(0), length)).otherwise(key)
    win = win.select(key.alias("w_hash"), "w_len", "w_text", "w_items")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws"))
    tokens = tokens.select("doc_id", "th", "ws", F.posexplode_outer("ws").alias("at", "word")).drop("word")
    if len(lengths) == 1:
        keyed = tokens.withColumn("len", F.lit(lengths[0])).withColumn("h", _hash(F.col("ws"), F.col("at"), lengths[0]))
    else:
        keys = F.array(*[F.struct(F.lit(x).alias("len"), _hash(F.col("ws"), F.col("at"), x).alias("h")) for x in lengths])
        keyed = tokens.select("doc_id", "th", "ws", "at", F.inline(keys))
    first = (F.col("len") == lengths[0]) & (F.coalesce(F.col("at"), F.lit(0)) == 0)
    window = F.array_join(F.slice("ws", F.col("at") + 1, F.col("len")), " ")
    on = (F.col("h") == F.col("w_hash")) & (F.col("len") == F.col("w_len"))
    item = F.struct("at", "len", F.col("w_items").alias("items"))
    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        met = keyed.withColumn("n_words", F.size("ws")).join(F.broadcast(win), on & (window == F.col("w_text")), "left")
        return met.where(F.col("w_hash").isNotNull() | first).groupBy("doc_id", "th").agg(
            F.count_if(first).alias("n_rows"),
            F.max("n_words").alias("n_words"),
            F.collect_set(F.when(F.col("w_hash").isNotNull(), item)).alias("hits"),
        )
    # Positions whose hash is a window's; only these travel with their words, to be verified.
    hashes = win.select("w_hash").distinct()
    if sum(sizes.values()) <= BROADCAST_HASHES:
        near = keyed.join(F.broadcast(hashes), F.col("h") == F.col("w_hash"), "left_semi").select("doc_id", "th", "at", "len", "h", window.alias("text"))
    else:
        thin = keyed.where(F.col("h").isNotNull()).select("doc_id", "th", "at", "len", "h").join(hashes, F.col("h") == F.col("w_hash"), "left_semi")
        whole = docs.select(F.col("doc_id").alias("d2"), F.xxhash64("text").alias("t2"), words(F.col("text")).alias("ws"))
        near = thin.join(whole, same(F.col("doc_id"), F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc_id", "th", "at", "len", "h", window.alias("text"))
    met = near.join(win, on & (F.col("text") == F.col("w_text"))).groupBy("doc_id", "th").agg(F.collect_set(item).alias("hits"))
    met = met.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "hits")
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).alias("n"))
    base = base.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n_rows"), F.max("n").alias("n_words"))
    joined = base.join(met, same(F.col("doc_id"), F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    return joined.select("doc_id", "th", "n_rows", "n_words", F.coalesce("hits", F.array().cast(met.schema["hits"].dataType)).alias("hits"))


def _hit_words() -> Column:
    return F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["len"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits. A null id is an id like others; repeated rows
    each get a row. Null items and items without a word have no windows; a null item_id counts as
    the empty string. Empty tables give no hits, or no rows. Whole texts are scanned, however long;
    only the named columns are read, so others can't clash.
    """
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda x: x["items"]))))
    found = scan(docs, benchmark, n).withColumn("n_hit", F.size(_hit_words()).cast("long")).withColumn("items", items)
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without contaminated documents (remove="documents") or without the words inside benchmark windows (remove="spans").

    A removed word goes with the separators that follow it; rows without hits stay as they are, null texts included.
    """
    d, h = fresh(docs, "hit_doc"), fresh(docs, "hit_text")
    found = scan(texts(docs, id_col, text_col), benchmark, n).where(F.size("hits") > 0)
    on = lambda: same(F.col(id_col), F.col(d)) & (F.xxhash64(F.col(text_col)) == F.col(h))
    if remove == "documents":
        return docs.join(found.select(F.col("doc_id").alias(d), F.col("th").alias(h)), on(), "left_anti")
    if remove != "spans":
        raise ValueError(f"remove: {remove}")
    gone = fresh(docs, "hit_words")
    joined = docs.join(found.select(F.col("doc_id").alias(d), F.col("th").alias(h), _hit_words().alias(gone)), on(), "left")
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    sep = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(f"({word}+{sep}*)"), 1)
    head = F.regexp_extract(F.col(text_col), f"^({sep}*)", 1)
    kept = F.concat(head, F.array_join(F.filter(pieces, lambda p, i: ~F.array_contains(gone, i)), ""))
    return joined.select(*[F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_WORDS = f"coalesce(regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{{{80}}}}-\\x{{{{10FFFF}}}}]+'), [])"
ORACLE = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), {N}) AS n, array_to_string(ws[i:i + least(len(ws), {N}) - 1], ' ') AS t
      FROM b, LATERAL (SELECT unnest(generate_series(1, len(ws) - least(len(ws), {N}) + 1)) AS i) WHERE len(ws) > 0),
d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
p AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t
      FROM d, (SELECT DISTINCT n FROM w), LATERAL (SELECT unnest(generate_series(1, len(ws) - n + 1)) AS i)),
h AS (SELECT doc_id, i, p.n, item FROM p JOIN w ON p.n = w.n AND p.t = w.t),
s AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, LATERAL (SELECT unnest(generate_series(i, i + n - 1)) AS j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
""".replace("{{", "{").replace("}}", "}")
