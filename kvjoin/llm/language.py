"""Language ID by hierarchical discrimination.

A text's hashed byte n-grams (2 and 3, letters only, lower case) first choose a
language family by one-versus-rest linear support vector machines; within the
family, a linear machine for every pair of its languages votes. Machines are
trained on the driver (squared hinge loss, accelerated gradient) on a bounded
sample per language; margins become probabilities by Platt's scaling.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, texts
from .textstats import as_bytes

#: The bound of the labelled sample: documents per language. There is none on languages.
MAX_PER_LANG = 500
DIM = 4096
#: Families by ISO 639-1 codes; a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky",
    "semitic": "ar he mt am",
    "indic": "hi bn ur mr gu pa ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu",
    "austronesian": "id ms jv su tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
#: Below this score the pipeline rejects a document, as it rejects und.
MIN_SCORE = 0.4

#: ASCII letters to lower case, other ASCII to a space; bytes of other letters stay.
_TO = np.array([b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint8)


def held_out(doc_id: Column) -> Column:
    """Null ids have the crc32 of the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def vector(text: bytes) -> np.ndarray:
    """Square roots of the n-grams' counts, of length 1."""
    a = _TO[np.frombuffer(b" " + text + b" ", np.uint8)]
    space = a == 32
    a = a[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint32)
    two = a[:-1] * np.uint32(257) + a[1:]
    three = two[:-1] * np.uint32(257) + a[2:]
    mix = lambda x, k: (x * np.uint32(k)) >> np.uint32(20)
    v = np.bincount(mix(two, 2654435761), minlength=DIM) + np.bincount(mix(three, 2246822519), minlength=DIM)
    v = np.sqrt(v.astype(np.float32))
    return v / max(float(np.sqrt(v @ v)), 1e-9)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    low = text.lower()
    return low.upper() != low or any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class Machine:
    w: np.ndarray
    b: float
    slope: float
    shift: float

    def prob(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.w + self.b) + self.shift, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, steps: int = 150) -> Machine:
    """y: booleans, some of each. Both classes weigh the same."""
    s = np.where(y, 1.0, -1.0).astype(np.float32)
    c = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum()).astype(np.float32)
    w, b, wp, bp = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    for k in range(steps):
        m = k / (k + 3)
        v, a = w + m * (w - wp), b + m * (b - bp)
        slack = np.maximum(0, 1 - s * (x @ v + a)) * s * c
        wp, bp = w, b
        w, b = v - (lam * v - 2 * (slack @ x)) / (lam + 4), a + 2 * float(slack.sum()) / (lam + 4)
    f = (x @ w + b).astype(float)
    t = np.where(y, (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(30):  # Newton steps, with a ridge that keeps separable classes finite
        p = 1 / (1 + np.exp(-np.clip(slope * f + shift, -30, 30)))
        g = np.array([c @ ((p - t) * f) + 1e-4 * slope, c @ (p - t) + 1e-4 * shift])
        q = c * p * (1 - p)
        h = np.array([[q @ (f * f) + 1e-4, q @ f], [q @ f, q.sum() + 1e-4]])
        d = np.clip(np.linalg.solve(h, g), -1, 1)
        slope, shift = slope - d[0], shift - d[1]
    return Machine(w, b, float(slope), float(shift))


@dataclass
class Model:
    langs: list[str]
    families: dict[str, list[str]]
    family: dict[str, Machine]
    pair: dict[tuple[str, str], Machine]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores of the vectors' rows."""
        names = sorted(self.families)
        if not names:
            return np.full(len(x), "und", object), np.zeros(len(x))
        p = np.stack([self.family[f].prob(x) for f in names], 1) if len(names) > 1 else np.ones((len(x), 1))
        p = p / np.maximum(p.sum(1, keepdims=True), 1e-12)
        best = p.argmax(1)
        lang, score = np.full(len(x), "und", object), p.max(1)
        for k, f in enumerate(names):
            rows, ls = np.flatnonzero(best == k), self.families[f]
            if not len(rows):
                continue
            votes, mass = np.zeros((len(rows), len(ls))), np.zeros((len(rows), len(ls)))
            for (i, a), (j, b) in combinations(enumerate(ls), 2):
                q = self.pair[a, b].prob(x[rows])
                votes[:, i] += q >= 0.5
                votes[:, j] += q < 0.5
                mass[:, i] += q
                mass[:, j] += 1 - q
            win = (votes + 1e-3 * mass).argmax(1)
            lang[rows] = np.array(ls, object)[win]
            if len(ls) > 1:
                score[rows] *= mass[np.arange(len(rows)), win] / (len(ls) - 1)
        return lang, score


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    langs = sorted(set(y))
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(FAMILY.get(lang, f"only {lang}"), []).append(lang)
    of = np.array([FAMILY.get(v, f"only {v}") for v in y], object)
    family = {f: train(x, of == f) for f in families} if len(families) > 1 else {}
    pair = {}
    for ls in families.values():
        for a, b in combinations(ls, 2):
            rows = (y == a) | (y == b)
            pair[a, b] = train(x[rows], y[rows] == a)
    return Model(langs, families, family, pair)


def sample(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Vectors and languages: of each sampled document the whole text, and a passage from its middle, so that short texts are learned too."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = d.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return np.zeros((0, DIM), np.float32), np.zeros(0, object)
    # Those with the smallest hashes; a threshold of about twice the bound spares the sort most texts.
    scale = 1 << 40
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(scale * min(1.0, 2 * MAX_PER_LANG / r["count"])) + 1))])
    d = d.withColumn("u", F.xxhash64("doc_id", "text")).where(F.pmod("u", F.lit(scale)) < F.try_element_at(share, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("u", F.lit(scale)), "u", "doc_id"))
    d = d.withColumn("nth", nth).where(F.col("nth") <= MAX_PER_LANG).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, vs = [], []
            for lang, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if has_letter(t):
                    words = t.split()
                    at = len(words) // 2
                    for part in (t, b" ".join(words[at : at + 3])):
                        if has_letter(part):
                            langs.append(lang)
                            vs.append(vector(part).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vs, pa.binary())], ["lang", "v"])

    rows = sorted(map(tuple, d.mapInArrow(vectors, "lang string, v binary").collect()))
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(-1, DIM).astype(np.float32)
    return x, np.array([r[0] for r in rows], object)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is und, with score 0; so is every text where nothing was
    learned. Repeated rows and null ids each get their row; equal texts have equal results. Whole texts are
    read, however long. An empty table gives an empty one. docs: as from texts(), so other columns can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                ts = as_bytes(b.column(2))
                rows = [i for i, t in enumerate(ts) if has_letter(t)]
                lang, score = np.full(len(ts), "und", object), np.zeros(len(ts))
                if rows:
                    lang[rows], score[rows] = model.predict(np.stack([vector(ts[i]) for i in rows]))
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """docs, all columns, without those that are und or whose score is below min_score."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                ts = as_bytes(b.column(b.schema.get_field_index(text_col)))
                keep = np.zeros(len(ts), bool)
                rows = [i for i, t in enumerate(ts) if has_letter(t)]
                if rows:
                    lang, score = model.predict(np.stack([vector(ts[i]) for i in rows]))
                    keep[rows] = (lang != "und") & (score >= min_score)
                yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(texts(docs), fit(*sample(docs)))
