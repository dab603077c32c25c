"""Quality rules: gradient-boosted trees over document statistics, flattened into numpy node arrays.

Trees are grown on the driver from a bounded sample of labelled documents, with
monotone constraints on the features that textstats.MONOTONE marks: a split whose
children's values would run against the constraint is refused, and the children
are bounded by the middle of the two values. All trees lie in five flat arrays;
scoring walks all documents of an Arrow batch down one level at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .textstats import BASE, FEATURES, MONOTONE, as_bytes, stats

#: The bound of the labelled sample, the only thing that is sampled.
MAX_LABELLED = 8_000
TREES, DEPTH, BINS, RATE, LEAST = 60, 3, 32, 0.2, 10
KEEP = 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


@dataclass
class Forest:
    """left < 0 marks a leaf; roots holds the first node of each tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality 1."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while (inner := self.left[at] >= 0).any():
                go = x[row, self.feature[at]] <= self.threshold[at]
                at = np.where(inner, np.where(go, self.left[at], self.right[at]), at)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] = MONOTONE) -> Forest:
    """Newton boosting of the logistic loss over quantile bins. Without rows, or with one class, there are no trees and the score is the (smoothed) share of 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    nodes: list[list[float]] = []
    roots: list[int] = []
    base = float(np.log(prior / (1 - prior)))
    if len(y) >= 2 * LEAST and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        f = np.full(len(y), base)

        def leaf(g: float, h: float, lo: float, hi: float) -> float:
            return float(np.clip(-g / (h + 1.0), lo, hi))

        def grow(rows: np.ndarray, depth: int, lo: float, hi: float) -> int:
            me = len(nodes)
            nodes.append([0, 0.0, -1, -1, RATE * leaf(g[rows].sum(), h[rows].sum(), lo, hi)])
            best = (1e-6, None)
            if depth < DEPTH and len(rows) >= 2 * LEAST:
                gt, ht = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[rows, j]
                    gl, hl, nl = (np.cumsum(np.bincount(c, w, len(e) + 1))[:-1] for w in (g[rows], h[rows], None))
                    ok = (nl >= LEAST) & (len(rows) - nl >= LEAST)
                    vl, vr = np.clip(-gl / (hl + 1), lo, hi), np.clip(-(gt - gl) / (ht - hl + 1), lo, hi)
                    ok &= (vr - vl) * monotone[j] >= 0
                    gain = np.where(ok, gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), -1)
                    if gain.max() > best[0]:
                        k = int(gain.argmax())
                        best = (gain[k], (j, k, float(vl[k]), float(vr[k])))
            if best[1]:
                j, k, vl, vr = best[1]
                mid = (vl + vr) / 2
                down = code[rows, j] <= k
                bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[monotone[j]]
                left = grow(rows[down], depth + 1, *bounds[0])
                right = grow(rows[~down], depth + 1, *bounds[1])
                nodes[me][:4] = [j, float(edges[j][k]), left, right]
            else:
                f[rows] += nodes[me][4]
            return me

        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, p * (1 - p)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    flat = np.array(nodes, float).reshape(-1, 5)
    whole = lambda k: flat[:, k].astype(np.int64)
    return Forest(np.array(roots, np.int64), whole(0), flat[:, 1], whole(2), whole(3), flat[:, 4], base)


def sample(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `most` labelled documents, chosen by a hash of their ids, in the order of ids. Null ids and labels are left out; of several labels of a document, 1 if half of them are."""
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    named = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a broadcast of at most `most` rows
    # Of rows with equal ids one counts: that whose text has the smallest hash.
    text = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    found = docs.join(F.broadcast(named), "doc_id").groupBy("doc_id", "y").agg(text).select("doc_id", "y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array([stats(t)[1] for t in as_bytes(b.column(2))], pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = sorted(found.mapInArrow(features, "doc_id long, y int, x array<double>").collect(), key=lambda r: r.doc_id)
    return np.array([r.x for r in rows], float).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], float)


def score(docs: DataFrame, forest: Forest, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, the BASE counts, base_failed, kept, score.

    Null and empty texts have no words, so they fail the base rules. Ids are passed on as they are,
    null and repeated ones too; equal texts have equal rows. Whole texts are counted, however long. An
    empty table gives an empty one. docs: as from texts(), so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                found = [stats(t) for t in as_bytes(b.column(1))]
                base = np.array([x[0] for x in found], np.int64).reshape(-1, len(BASE))
                s = forest.score(np.array([x[1] for x in found], float).reshape(-1, len(FEATURES)))
                failed = (base[:, 0] < 20) | (100 * base[:, 4] > 30 * base[:, 0])
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *map(pa.array, base.T), pa.array(failed), pa.array(~failed & (s >= keep)), pa.array(s)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    return score(docs, fit(*sample(docs, table(spark, sf_dir, "labels"))))
