"""Toxicity by the nearest labelled examples.

A bounded sample of labelled documents is indexed by all its words, weighted by term
frequency, by an inverse document frequency that is counted over all documents, and
by how well the word tells the classes apart (chi-squared; no word weighs nothing).
Examples are arranged by likeness and cut into blocks. A search adds up the postings of the
rarer words; postings of the frequent words lie block by block, with the maximum weight of each word
in each block. Those maxima bound what a block can reach: the best blocks are visited first,
then all that can still beat the k-th best, no others: the exact cosine top k. Votes are
weighted by similarity and calibrated on the examples, each left out in turn.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .language import held_out
from .textstats import as_bytes

#: The bound of the labelled sample, per class.
MAX_PER_CLASS = 1_500
#: Telling terms: of so many examples, and of such a chi-squared; at that a term has half of the weight by class. FLOOR: of the other half, for any term.
MIN_DF, MIN_CHI2, FLOOR = 5, 30.0, 0.01
#: Terms whose document frequencies travel as one row.
CHUNK = 4096
#: Examples in a block, blocks visited first, words whose postings lie by blocks, nearest examples.
BLOCK, FIRST, FREQUENT, K = 64, 2, 2048, 15
#: For the arrangement of the examples: clusters, columns that words are hashed to, rounds.
CLUSTERS, COLUMNS, ROUNDS = 32, 512, 8
#: Texts searched at once.
BATCH = 200
CUT = 0.3
_TABLE = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words of letters, ASCII ones in lower case."""
    return (text or b"").translate(_TABLE).split()


class Terms:
    """Counts a text's words that are in the vocabulary."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known

    def count(self, text: bytes | None) -> dict[int, int]:
        known = self.known
        return {i: n for w, n in Counter(words(text)).items() if (i := known.get(w)) is not None}


@dataclass
class Index:
    ids: np.ndarray  # of the examples, by position
    rank: np.ndarray  # of the examples, in the order of ids
    toxic: np.ndarray
    vocabulary: dict[bytes, int]
    idf: np.ndarray  # times the weight by class
    telling: dict[int, str]  # names of the words that tell the classes apart
    first: np.ndarray  # term -> first posting; one more
    example: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    silent: float = 0.0  # score of a text that shares no word with any example
    seen: dict = field(default_factory=dict)

    def __post_init__(self):
        self.terms = Terms(self.vocabulary)
        per, blocks = np.diff(self.first), max(1, -(-len(self.ids) // BLOCK))
        often = np.sort(np.argsort(-per, kind="stable")[:FREQUENT])
        self.row = np.full(len(per), -1)
        self.row[often] = np.arange(len(often))
        row = np.repeat(self.row, per)
        mine = row >= 0
        self.dense = np.zeros((blocks, len(often), BLOCK))
        self.dense[self.example[mine] // BLOCK, row[mine], self.example[mine] % BLOCK] = self.weight[mine]
        self.maxima = self.dense.max(2).T

    def __getstate__(self):
        """Without what follows from the postings."""
        return {k: v for k, v in self.__dict__.items() if k not in ("terms", "row", "dense", "maxima", "seen")}

    def __setstate__(self, state: dict):
        self.__dict__.update(state, seen={})
        self.__post_init__()

    def query(self, counts: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array([c[0] for c in counts], np.int64)
        q = (1 + np.log([c[1] for c in counts])) * self.idf[t]
        return t, q / max(np.sqrt(q @ q), 1e-12)

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights): (cosine, example) of the k nearest with a cosine above 0; equal ones in the order of ids. skip: an example to leave out for each query. visited counts pairs of query and block."""
        out, self.visited = [], 0
        for at in range(0, len(queries), BATCH):
            out += self._search(queries[at : at + BATCH], k, None if skip is None else np.array(skip[at : at + BATCH]))
        return out

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, skip: np.ndarray | None) -> list[list[tuple[float, int]]]:
        m, blocks, width = len(queries), len(self.dense), len(self.dense) * BLOCK
        of = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        t, q = (np.concatenate([x[j] for x in queries]) for j in (0, 1))
        row = self.row[t]
        often = row >= 0
        heavy = np.zeros((m, self.dense.shape[1]))
        heavy[of[often], row[often]] = q[often]
        rare, q, of = t[~often], q[~often], of[~often]
        n = self.first[rare + 1] - self.first[rare]
        end = np.cumsum(n)
        at = np.arange(n.sum()) + np.repeat(self.first[rare] - (end - n), n)
        sums = np.bincount(np.repeat(of, n) * width + self.example[at], self.weight[at] * np.repeat(q, n), m * width).astype(float).reshape(m, blocks, BLOCK)
        bound = sums.max(2) + heavy @ self.maxima
        done = np.zeros((m, blocks), bool)
        first = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]
        todo = np.zeros((m, blocks), bool)
        np.put_along_axis(todo, first, True, 1)
        for _ in range(2):
            for b in np.flatnonzero(todo.any(0)):
                rows = np.flatnonzero(todo[:, b])
                sums[rows, b] += heavy[rows] @ self.dense[b]
            done |= todo
            self.visited += int(todo.sum())
            flat = np.where(done[:, :, None], sums, 0).reshape(m, width).round(12)
            if skip is not None:
                flat[np.arange(m), skip] = 0
            low = max(width - k, 0)
            kth = np.partition(flat, low, axis=1)[:, low]
            todo = ~done & (bound > 0) & (bound >= kth[:, None] - 1e-9)
        out = []
        for i in range(m):
            hits = np.flatnonzero((flat[i] > 0) & (flat[i] >= kth[i]))
            hits = hits[np.lexsort((self.rank[hits], -flat[i, hits]))][:k]
            out.append([(float(flat[i, j]), int(j)) for j in hits])
        return out

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near)
        return sum(s * self.toxic[i] for s, i in near) / total if total else 0.0

    def score(self, texts: list[bytes | None]) -> list[tuple[float, list[int], list[str]]]:
        """For each text its calibrated score, ids of the three nearest examples, and its telling words. Equal texts are scored once."""
        keys = [hashlib.md5(x or b"").digest() for x in texts]
        if len(self.seen) > 20_000:
            self.seen.clear()
        new = {k: x for k, x in zip(keys, texts, strict=True) if k not in self.seen}
        counts = {k: sorted(self.terms.count(x).items()) for k, x in new.items()}
        known = [k for k, c in counts.items() if c]
        near = dict(zip(known, self.search([self.query(counts[k]) for k in known]), strict=True))
        for k, c in counts.items():
            got = near.get(k)
            p = float(1 / (1 + np.exp(-(self.slope * self.vote(got) + self.shift)))) if got else self.silent
            self.seen[k] = (p, [int(self.ids[i]) for _, i in (got or [])[:3]], [self.telling[i] for i, _ in c if i in self.telling])
        return [self.seen[k] for k in keys]


class Bag:
    """An example's terms and counts, held as bytes."""

    def __init__(self, terms: bytes, counts: np.ndarray):
        self.terms, self.counts = terms, counts

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.terms.split(b" ") if self.terms else [])

    def items(self) -> Iterator[tuple[bytes, int]]:
        return zip(self, self.counts.tolist(), strict=True)


def vocabulary(bags: list[Counter | Bag]) -> list[bytes]:
    """All terms of the examples."""
    return sorted({t for bag in bags for t in bag})


def chi_squared(a: np.ndarray, df: np.ndarray, pos: int, n: int) -> np.ndarray:
    """Of terms in df of n examples, a of them among the pos toxic ones; 0 where a class or either side of the term is empty."""
    b = df - a
    return n * (a * (n - pos - b) - b * (pos - a)) ** 2 / np.maximum(df * (n - df) * pos * (n - pos), 1e-9)


def arranged(example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The examples' positions, like ones together: by spherical k-means over hashed words. It makes no difference to results, only to how many blocks a search visits."""
    x = np.bincount(example * COLUMNS + term * 2654435761 % (1 << 32) % COLUMNS, weight, n * COLUMNS).reshape(n, COLUMNS)
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    centres = x[np.linspace(0, n - 1, min(CLUSTERS, n)).astype(int)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(1)
        centres = np.stack([x[own == j].sum(0) if (own == j).any() else c for j, c in enumerate(centres)])
        centres /= np.maximum(np.sqrt((centres * centres).sum(1, keepdims=True)), 1e-12)
    return np.argsort(own, kind="stable")


def build(ids: list[int], bags: list[Counter | Bag], y: np.ndarray, terms: list[bytes], df: np.ndarray, n_docs: int, share: float) -> Index:
    """share: of toxic ones among all labelled rows; the sample's classes are weighed to it in the calibration."""
    known = {w: i for i, w in enumerate(terms)}
    own = [np.array([(known[w], c) for w, c in bag.items() if w in known], np.int32).reshape(-1, 2) for bag in bags]
    example = np.repeat(np.arange(len(own)), [len(x) for x in own])
    term, count = np.concatenate([*own, np.zeros((0, 2), np.int32)]).T
    a, per = np.bincount(term, y[example], len(terms)), np.bincount(term, minlength=len(terms))
    chi2 = chi_squared(a, per.astype(float), y.sum(), len(y))
    idf = (np.log((1 + n_docs) / (1 + df)) + 1) * (chi2 / (chi2 + MIN_CHI2) + FLOOR)
    weight = (1 + np.log(count)) * idf[term]
    weight /= np.sqrt(np.bincount(example, weight * weight, len(own)))[example]
    telling = {int(i): terms[i].decode("utf-8", "replace") for i in np.flatnonzero((per >= MIN_DF) & (chi2 >= MIN_CHI2))}
    at = arranged(example, term.astype(np.int64), weight, len(own)) if len(own) else np.zeros(0, np.int64)
    place = np.argsort(at)
    order = np.lexsort((place[example], term))
    toxic = y.astype(float)[at]
    index = Index(np.array(ids, np.int64)[at], at, toxic, known, idf, telling, np.concatenate(([0], np.cumsum(per))).astype(np.int32), place[example][order].astype(np.int32), weight[order])
    counts = [(int(place[e]), sorted(map(tuple, x.tolist()))) for e, x in enumerate(own) if len(x)]
    near = index.search([index.query(c) for _, c in counts], skip=[e for e, _ in counts])
    votes, told = np.zeros(len(own)), np.zeros(len(own), bool)
    for (e, _), got in zip(counts, near, strict=True):
        votes[e], told[e] = index.vote(got), bool(got)
    pos = toxic.sum()
    w = np.where(toxic == 1, share / max(pos, 1), (1 - share) / max(len(toxic) - pos, 1)) if len(toxic) else np.zeros(0)
    index.slope, index.shift = _platt(votes[told], toxic[told], w[told])
    quiet = ~told
    index.silent = float((w[quiet] @ toxic[quiet] + 1e-4 * share) / (w[quiet].sum() + 1e-4)) if len(toxic) else 0.0
    return index


def _platt(v: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the vote, with a small ridge."""
    if not len(v) or not 0 < y.sum() < len(y):
        p = min(max(float(y.mean()) if len(y) else 0.0, 0.01), 0.99)
        return 0.0, float(np.log(p / (1 - p)))
    w = w / w.sum()
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * v + b, -30, 30)))
        g = np.array([w @ ((p - y) * v) + 1e-4 * a, w @ (p - y) + 1e-4 * b])
        q = w * p * (1 - p)
        h = np.array([[q @ (v * v) + 1e-4, q @ v], [q @ v, q.sum() + 1e-4]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = a - d[0], b - d[1]
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """docs: as from texts(). Labels of held-out rows are never read; a document labelled more than once counts as toxic if half of its labels do."""
    named = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    named = named.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in named.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = named.where("y = 1").orderBy(*order).limit(MAX_PER_CLASS).union(named.where("y = 0").orderBy(*order).limit(MAX_PER_CLASS))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = [Counter(words(x)) for x in as_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([b" ".join(c) for c in counted], pa.binary()), pa.array([list(c.values()) for c in counted], pa.list_(pa.int32()))], ["doc_id", "y", "w", "c"])

    # Of rows with equal ids one is an example: that whose text has the smallest hash.
    text = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    found = docs.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(text).mapInArrow(bag, "doc_id long, y int, w binary, c array<int>").collect()
    found.sort(key=lambda r: r["doc_id"])
    bags = [Bag(bytes(r["w"]), np.array(r["c"], np.int32)) for r in found]
    ids, y = [r["doc_id"] for r in found], np.array([r["y"] for r in found], int)
    del found
    terms = vocabulary(bags)
    df, n_docs = document_frequencies(docs, terms)
    return build(ids, bags, y, terms, df, n_docs, sizes.get(1, 0) / max(sum(sizes.values()), 1))


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """Of the vocabulary's terms, over all documents; and the number of documents. A task sends a row for every CHUNK of terms."""
    known = {w: i for i, w in enumerate(terms)}
    schema = "chunk int, n binary"

    def rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, of = np.zeros(len(known) + 1, np.int64), Terms(known)
        for b in batches:
            df[-1] += b.num_rows
            for t in as_bytes(b.column(0)):
                df[list(of.count(t))] += 1
        yield rows({i: df[i * CHUNK : (i + 1) * CHUNK] for i in range(-(-len(df) // CHUNK))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, n in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(n, np.int64)
        yield rows(sums)

    df = np.zeros(len(terms) + 1, np.int64)
    for r in docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(add, schema).collect():
        df[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["n"]), np.int64)
    return df[:-1].astype(float), int(df[-1])


def score(docs: DataFrame, index: Index) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, nearest (ids of the three nearest examples), evidence (the text's telling terms).

    Null and empty texts score as texts that share no word with any example. Whole texts are scored, however
    long. Repeated rows and null ids each get their row; equal texts have equal scores. Without labelled
    rows every score is 0. An empty table gives an empty one. docs: as from texts(), so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = index.score(as_bytes(b.column(2)))
            s = np.clip([g[0] for g in got], 0, 1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32)), pa.array([g[1] for g in got], pa.list_(pa.int64())), pa.array([g[2] for g in got], pa.list_(pa.string()))],
                ["doc_id", "held_out", "score", "predicted", "nearest", "evidence"],
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, nearest array<long>, evidence array<string>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
