"""Substring dedup with prefix-partitioned suffix trees over words.

A window is WINDOW consecutive words. A word goes if a window that covers it also
starts in a document with a smaller id.

1. anchors: each window's anchor is its run of PART consecutive words with the smallest
   hash, so a window that repeats elsewhere has an anchor that repeats in another
   text. Only windows whose anchor does so can be repeats; all other suffixes are
   left out without loss. Equal whole texts count as one text here.
2. suffixes: those suffixes, WINDOW words deep, are dealt out by a prefix whose length
   varies: as many words as it takes for the estimated number of suffixes with
   that prefix (from word counts over all documents, with room for runs of words that are CLUSTERED times as
   frequent as their words alone say) to fit a memory-sized group. There are as many
   groups as the words need, each of many prefixes; a task gets its groups sorted and holds one at a time.
3. trees: each group's suffix trees, cut at WINDOW words, are built as sorted suffixes
   with their longest common prefixes; inner nodes as deep as WINDOW are the
   repeats, and their leaves in other than the smallest document are removed.
   The same tree first runs within each map task as a combiner, so that a passage
   that a third of all documents share sends one document's suffix from each block.
4. copies: of equal whole texts the smallest id is the text's own document; the others
   lose every word if they have a window at all.

Texts are shuffled once, by their hash; both readers share that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, same, table, texts
from .textstats import as_bytes, window_hashes, word_hashes

WINDOW, PART = 13, 7
#: Suffixes of a memory-sized group (about 60 bytes each), and words after which a map task closes a block.
GROUP, BLOCK_WORDS = 1_000_000, 3_000_000
#: Copies make long runs of words this much more frequent than independent words would be.
CLUSTERED = 1e6
#: Words of all documents for which there is one group of anchors or suffixes.
GROUP_WORDS = 2_000_000
SKETCH = 4096
NO_ID = np.iinfo(np.int64).max
_LOW48, _LOW16 = np.uint64((1 << 48) - 1), np.uint64((1 << 16) - 1)


def _z(a: np.ndarray) -> bytes:
    """Bytes of an array, transposed so that bytes of equal weight lie together, compressed."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1) if len(a) else b""


def _u(b: bytes, kind: type, width: int = 0) -> np.ndarray:
    """What _z() compressed; width: columns of a matrix."""
    if not b:
        return np.empty((0, width) if width else 0, kind)
    size = np.dtype(kind).itemsize * max(width, 1)
    flat = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T
    out = np.ascontiguousarray(flat).view(kind)
    return out.reshape(-1, width) if width else out.reshape(-1)


class Groups:
    """Groups of keys, numbered, and the partitions that they are dealt to evenly: as many groups as the words need, at least one and at most 16 partitions for each that Spark is set to, and several groups in a partition beyond that."""

    def __init__(self, spark: SparkSession, words: int):
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.count = max(n, -(-words // GROUP_WORDS))
        self.partitions = max(n, min(self.count, 16 * n))
        p = self.partitions
        # For each partition a number that Spark's hash partitioning sends there.
        to = spark.range(16 * p).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(p)).alias("p"), F.col("id").cast("int").alias("id")).groupBy("p").agg(F.min("id").alias("id")).collect()
        self.number = np.arange(p, dtype=np.int64)
        for r in to:
            self.number[r["p"]] = r["id"]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The group of each key, 64 bits."""
        return (keys.astype(np.uint64, copy=False) % np.uint64(self.count)).astype(np.int64)

    def part(self, group: int) -> int:
        return int(self.number[group % self.partitions])

    def deal(self, df: DataFrame) -> DataFrame:
        """df (part, grp, ...) in its partitions, the rows of a group together."""
        return df.repartition(self.partitions, "part").sortWithinPartitions("grp")


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows, without part and grp, of one group after the other."""
    rows, last = [], None
    for b in batches:
        for _, g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and g != last:
                yield rows
                rows = []
            rows.append(row)
            last = g
    if rows:
        yield rows


def anchor_of_windows(words: np.ndarray, window: int = WINDOW, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's position, the leftmost minimum of the hashes of its runs of part words; and those hashes by position."""
    h = window_hashes(words, part)
    n = window - part + 1
    if len(h) < n:
        return np.empty(0, np.int64), h
    return np.lib.stride_tricks.sliding_window_view(h, n).argmin(1) + np.arange(len(h) - n + 1), h


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[list[tuple]]:
    """Rows of the batches, with the hashes of the text's words for the text, in lists of about `most` words."""
    rows, n = [], 0
    for whole in batches:
        for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
            cols = [as_bytes(c) if k == text_at else c.to_pylist() for k, c in enumerate(b.columns)]
            for row in zip(*cols, strict=True):
                words = word_hashes((row[text_at] or b"").split())
                rows.append((*row[:text_at], words, *row[text_at + 1 :]))
                n += len(words)
                if n >= most:
                    yield rows
                    rows, n = [], 0
    if rows:
        yield rows


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each key, in order."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        cut = np.flatnonzero(np.diff(keys[order])) + 1
        for rows in np.split(order, cut):
            yield int(keys[rows[0]]), rows


PACKED = "part int, grp int, d binary, n binary, at binary"


def _packed(rows: list[tuple[int | None, int, bytes]], groups: Groups) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, t8, positions) as one row for each group that t8 belongs to, so that tasks exchange groups and not documents."""
    if not rows:
        return
    key = np.array([(NO_ID if d is None else d, t) for d, t, _ in rows], np.int64)
    out = []
    for g, r in _by(key[:, 1] % groups.count):
        at = [np.frombuffer(rows[i][2], np.int32) for i in r]
        out.append((groups.part(g), g, _z(key[r]), _z(np.array([len(x) for x in at], np.uint32)), _z(np.concatenate(at))))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "grp", "d", "n", "at"])


def _gathered(packed: DataFrame, groups: Groups) -> DataFrame:
    """(doc_id, t8, at): one row for each (doc_id, t8), with all its positions."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            d = np.concatenate([np.repeat(_u(d, np.int64, 2), _u(n, np.uint32), axis=0) for d, n, _ in rows])
            out = _removed(d[:, 0], d[:, 1], np.concatenate([_u(at, np.int32) for *_, at in rows]))
            for k in range(0, len(out), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 5000], strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "t8", "at"])

    return groups.deal(packed).mapInArrow(merge, "doc_id long, t8 long, at binary")


def word_counts(docs: DataFrame) -> np.ndarray:
    """Words by hash bucket, SKETCH of them, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for rows in _blocks(batches, 0, BLOCK_WORDS):
            for (words,) in rows:
                total += np.bincount((words % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH)), pa.array(total)], ["bucket", "n"])

    got = np.zeros(SKETCH, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        got[r["bucket"]] = r["n"]
    return got


def repeated_anchors(docs: DataFrame, groups: Groups, window: int = WINDOW, part: int = PART) -> DataFrame:
    """(t8, ats): where anchors of the text with hash t8 start that another text has too. docs: (t8, text)."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 1, BLOCK_WORDS):
            seen, hs, ats, ds, keys = set(), [], [], [], []
            for t8, words in rows:
                if t8 in seen:
                    continue
                seen.add(t8)
                at, h = anchor_of_windows(words, window, part)
                if len(at):
                    at = np.unique(at)
                    hs.append(h[at] & _LOW48)
                    ats.append(at.astype(np.uint32))
                    ds.append(np.full(len(at), len(keys), np.uint32))
                    keys.append(t8)
            if not keys:
                continue
            key = np.array(keys, np.int64)
            h, at, d = map(np.concatenate, (hs, ats, ds))
            order = np.lexsort((d, h))
            h, at, d = h[order], at[order], d[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            shared = (np.maximum.reduceat(d, first) != d[first])[group]  # known here to be repeated
            out: list[tuple] = []
            # What is decided here only passes through the next task, dealt by text and not by hash.
            of = key % groups.count
            for doc, r in _by(np.where(shared, d.astype(np.int64), NO_ID)):
                if doc != NO_ID:
                    out.append((groups.part(of[doc]), int(of[doc]), int(key[doc]), _z(at[r]), b"", b""))
            send = np.where(shared, new, True)
            h, at, d = h[send], at[send], d[send]
            order = np.lexsort((at, d))
            h, at, d = h[order], at[order], d[order]
            for g, r in _by(groups.of(h)):
                six = np.ascontiguousarray(h[r].view(np.uint8).reshape(-1, 8)[:, :6])
                own, index = np.unique(d[r], return_inverse=True)
                out.append((groups.part(g), g, None, _z(at[r]), _z(six), _z(np.concatenate((key[own], index.astype(np.int64), [len(own)])))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "grp", "t8", "at", "h", "d"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            hs, ats, ts, out = [], [], [], []
            for t8, at, h, d in rows:
                if t8 is not None:
                    out.append((None, t8, _u(at, np.uint32).astype(np.int32).tobytes()))
                    continue
                six = _u(h, np.uint8, 6)
                eight = np.zeros((len(six), 8), np.uint8)
                eight[:, :6] = six
                hs.append(eight.view(np.uint64).reshape(-1))
                ats.append(_u(at, np.uint32).astype(np.int32))
                both = _u(d, np.int64)
                n = both[-1]
                ts.append(both[:n][both[n:-1]])
            if hs:
                h, at, t = map(np.concatenate, (hs, ats, ts))
                order = np.argsort(h, kind="stable")
                h, at, t = h[order], at[order], t[order]
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                shared = np.repeat(np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first), np.diff(np.append(first, len(h))))
                at, t = at[shared], t[shared]
                out += [(None, t8, at[r].tobytes()) for t8, r in _by(t)]
            yield from _packed(out, groups)

    sent = docs.select("t8", "text").mapInArrow(select, "part int, grp int, t8 long, at binary, h binary, d binary")
    return _gathered(groups.deal(sent).mapInArrow(meet, PACKED), groups).select("t8", F.array("at").alias("ats"))


class Prefixes:
    """Which prefix a suffix belongs to: the shortest one whose estimated number of suffixes is GROUP at most, even if it is CLUSTERED times as frequent as independent words."""

    def __init__(self, counts: np.ndarray):
        total = max(int(counts.sum()), 1)
        self.share = np.log(np.maximum(counts, 1) / total)
        self.room = np.log(GROUP / total / CLUSTERED)

    def group(self, suffixes: np.ndarray) -> np.ndarray:
        """Hash of the prefix and its length. suffixes: (n, WINDOW), the low bits of the words' hashes."""
        left = np.zeros(len(suffixes))
        h = np.zeros(len(suffixes), np.uint64)
        for k in range(WINDOW):
            more = (left > self.room) | (k == 0)
            if not more.any():
                break
            w = suffixes[:, k].astype(np.uint64)
            left = np.where(more, left + self.share[(w % np.uint64(SKETCH)).astype(np.int64)], left)
            h = np.where(more, (h ^ w) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1), h)
        return h ^ (h >> np.uint64(31))


class Tree:
    """Suffix tree of the given suffixes, cut at WINDOW words: suffixes in sorted order and the longest common prefix, in words, of each with the one before it. An inner node of depth n is a longest run of suffixes whose common prefixes are n at least."""

    def __init__(self, suffixes: np.ndarray, check: np.ndarray):
        """suffixes: (n, WINDOW), bits of each word's hash; check: 64-bit hash of the words' whole hashes, which tells suffixes of depth WINDOW apart."""
        both = np.concatenate((suffixes, np.ascontiguousarray(check).view(suffixes.dtype).reshape(len(check), -1)), 1)
        rows = np.ascontiguousarray(both).view(np.dtype((np.void, both.shape[1] * both.itemsize))).reshape(-1)
        self.order = np.argsort(rows)
        s = both[self.order]
        same_ = s[1:] == s[:-1]
        depth = np.where(same_.all(1), WINDOW, np.minimum((~same_[:, :WINDOW]).argmax(1), WINDOW - 1)) if len(s) > 1 else np.empty(0, np.int64)
        self.lcp = np.concatenate(([0], depth))

    def nodes(self, depth: int) -> np.ndarray:
        """For each suffix in sorted order, the number of the node of that depth above it."""
        return np.cumsum(self.lcp < depth) - 1


def repeats(suffixes: np.ndarray, check: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of suffixes that a smaller doc has too, and of all others: those of each node's smallest doc."""
    if not len(suffixes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    tree = Tree(suffixes, check)
    node = tree.nodes(WINDOW)
    first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    d = doc[tree.order]
    least = np.minimum.reduceat(d, first)[node]
    later = d > least
    return tree.order[later], tree.order[~later]


def _removed(doc: np.ndarray, t8: np.ndarray, start: np.ndarray) -> list[tuple[int | None, int, bytes]]:
    out = []
    if len(doc):
        order = np.lexsort((start, t8, doc))
        doc, t8, start = doc[order], t8[order], start[order]
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (t8[1:] != t8[:-1])) + 1
        for r in np.split(np.arange(len(doc)), cut):
            i = int(doc[r[0]])
            out.append((None if i == NO_ID else i, int(t8[r[0]]), start[r].astype(np.int32).tobytes()))
    return out


def later_repeats(docs: DataFrame, prefixes: Prefixes, groups: Groups) -> DataFrame:
    """(doc_id, t8, starts): windows whose words also start in a document with a smaller id. docs: (doc_id, t8, text, ats), a row per text."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, 2, BLOCK_WORDS):
            hashes, starts, docs_, keys, base = [], [], [], [], 0
            for doc, t8, h, ats in rows:
                if len(h) < WINDOW or not ats:
                    continue
                repeated = np.zeros(len(h), bool)
                repeated[np.concatenate([np.frombuffer(a, np.int32) for a in ats])] = True
                s = np.flatnonzero(repeated[anchor_of_windows(h)[0]])  # windows whose own anchor repeats
                hashes.append(h)
                starts.append(s + base)
                docs_.append(np.full(len(s), len(keys), np.int64))
                keys.append((NO_ID if doc is None else doc, t8, base))
                base += len(h)
            if not hashes:
                continue
            words, s, of = map(np.concatenate, (hashes, starts, docs_))
            if not len(s):
                continue
            doc, key, first = np.array(keys, np.int64).T
            start = s - first[of]
            deep = np.lib.stride_tricks.sliding_window_view((words & _LOW16).astype(np.uint16), WINDOW)[s]
            check = window_hashes(words, WINDOW)[s]
            later, one = repeats(deep, check, doc[of])
            out: list[tuple] = []
            for i, t8, x in _removed(doc[of[later]], key[of[later]], start[later]):
                g = t8 % groups.count
                out.append((groups.part(g), g, i, t8, x, b"", b"", b""))
            one = np.sort(one)  # by text and position, which compresses well
            for g, r in _by(groups.of(prefixes.group(deep[one]))):
                k = one[r]
                own, index = np.unique(of[k], return_inverse=True)
                at = np.stack((index, start[k]), 1).astype(np.uint32)
                out.append((groups.part(g), g, None, None, _z(np.stack((doc[own], key[own]), 1)), _z(np.ascontiguousarray(deep[k])), _z(check[k]), _z(at)))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "grp", "doc_id", "t8", "starts", "s", "c", "at"])

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_group(batches):
            ss, cs, ds, ats, out = [], [], [], [], []
            for doc, t8, starts, s, c, at in rows:
                if t8 is not None:
                    out.append((doc, t8, starts))
                else:
                    both = _u(at, np.uint32, 2)
                    ss.append(_u(s, np.uint16, WINDOW))
                    cs.append(_u(c, np.uint64))
                    ds.append(_u(starts, np.int64, 2)[both[:, 0]])
                    ats.append(both[:, 1])
            if ss:
                s, c, d, at = map(np.concatenate, (ss, cs, ds, ats))
                later, _ = repeats(s, c, d[:, 0])  # sorted together, the subtrees of the prefixes lie one after the other
                out += _removed(d[later, 0], d[later, 1], at[later])
            yield from _packed(out, groups)

    sent = docs.mapInArrow(combine, "part int, grp int, doc_id long, t8 long, starts binary, s binary, c binary, at binary")
    return _gathered(groups.deal(sent).mapInArrow(trees, PACKED), groups).select("doc_id", "t8", F.array("at").alias("starts"))


def covered(n: int, starts: list[bytes] | None) -> np.ndarray:
    """Which of n words lie in windows with the given starts."""
    edge = np.zeros(n + 1, np.int64)
    if starts:
        at = np.concatenate([np.frombuffer(x, np.int32) for x in starts]).astype(np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + WINDOW, n), -1)
    return np.cumsum(edge[:-1]) > 0


def find(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with copy (an equal text has a smaller id) and starts (windows to remove)."""
    counts = word_counts(docs)
    prefixes, groups = Prefixes(counts), Groups(docs.sparkSession, int(counts.sum()))
    d = docs.withColumn("t8", F.xxhash64("text")).withColumn("md", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    own = d.groupBy("t8", "md").agg(F.min("doc_id").alias("first"))
    near = repeated_anchors(d, groups)
    # One row for each text: its own document's id and its anchors.
    known = own.join(near.withColumnRenamed("t8", "k8"), F.col("t8") == F.col("k8"), "left").select("t8", "md", "first", "ats")
    me = hot_join(d, known, ["t8", "md"])
    # Equality as a difference, which the planner doesn't take for one more join key: both joins with d then share its exchange.
    apart = F.coalesce("doc_id", F.lit(NO_ID)).bitwiseXOR(F.coalesce("first", F.lit(NO_ID)))
    mine = me.where((apart == 0) & F.col("ats").isNotNull()).select("doc_id", "t8", "text", "ats")
    gone = later_repeats(mine, prefixes, groups).withColumnsRenamed({"doc_id": "g_id", "t8": "g8"})
    told = own.join(gone, same(F.col("first"), F.col("g_id")) & (F.col("t8") == F.col("g8")), "left").select("t8", "md", "first", "starts")
    copy = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return hot_join(d, told, ["t8", "md"]).select("doc_id", "text", F.coalesce(copy, F.lit(False)).alias("copy"), "starts")


def _kept(words: list[bytes], copy: bool, starts: list[bytes] | None) -> tuple[int, list[bytes]]:
    if copy and len(words) >= WINDOW:
        return len(words), []
    gone = covered(len(words), starts)
    return int(gone.sum()), [w for w, x in zip(words, gone, strict=True) if not x] if gone.any() else words


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Null and empty texts have no words; texts of fewer than 13 words lose none. A null id comes after
    all others, and documents with null ids don't remove from each other. Rows with equal ids don't
    either; equal rows each get their row. Whole texts are searched, however long. An empty table gives an
    empty one; only doc_id and text are read, so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, copy, starts in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                n, kept = _kept(words, copy, starts)
                out.append((doc, len(words), n, hashlib.sha256(b" ".join(kept)).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return find(texts(docs)).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM d),
p AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS t FROM d, LATERAL (SELECT unnest(generate_series(1, len(ws) - {WINDOW - 1})) AS i)),
f AS (SELECT t, min(doc_id) AS first FROM p GROUP BY t),
g AS (SELECT DISTINCT doc_id, i + j AS i FROM p JOIN f USING (t), (SELECT unnest(range({WINDOW})) AS j) WHERE doc_id > first),
k AS (SELECT w.doc_id, count(g.i) AS n_removed, string_agg(w.x, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS kept FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
