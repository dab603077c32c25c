"""MinHash near-dedup by ProbMinHash.

A text's shingles are its runs of five words, weighted by how often they occur. Each
shingle is a Poisson process whose rate is its weight; arrivals go to random
registers, and a register keeps the shingle of its earliest arrival. A shingle stops
as soon as its next arrival comes after the latest register: early termination.
Two texts agree in a register with the probability Jaccard similarity of their weights.
A text in which a shingle repeats has a second sketch with all weights 1, so that texts
meet by the Jaccard similarity of their sets, too; for other texts both sketches are one.

Registers are banded; texts that meet in a band are candidates. Equal texts are one
node from the start. Each bucket first has one leader (the text that meets most
others, mostly the original of its copies), which is verified against the bucket's
members (exact probability Jaccard, or Jaccard of the sets, of SIMILARITY at least), and
linked texts become classes. What is left to compare are members of different classes
of a bucket. Of those, only pairs that pass an exact bound leave the join: every text carries a bitmap of its
shingles, and bits that one bitmap has alone tell how many shingles the texts can't
share. Leaders multiply from round to round, classes are joined after each, and the last round
takes all that is left, so no link between classes is lost among texts that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, hot_join, materialize, same, table, texts
from .textstats import as_bytes, window_hashes, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: 48 bands of 10 registers: a pair of similarity 0.8 meets with probability 0.9956, one of 0.85 with 0.9999, one of 0.6 with 0.25, one of 0.5 with 0.05.
BANDS, ROWS = 48, 10
#: A text's bitmap has 64 bits in each of so many longs.
LONGS = 32
SIGNATURE = [*(f"bits{i}" for i in range(LONGS)), "ones", "size", "mass"]
#: Leaders of a bucket in the first round after the single one, by how much they multiply in each round, and comparisons a member up to which all that is left is done in one round.
LEADERS, TIMES, LINEAR = 16, 4, 1024
SPACES = " \t\n\x0b\f\r"


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and their counts; a text of fewer than five words is one shingle, one without words has none."""
    words = (text or b"").split()
    h = window_hashes(word_hashes(words), min(SHINGLE, max(len(words), 1)))
    return np.unique(h, return_counts=True)


def sketch(items: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """Registers (n_docs, m) of texts that each have a shingle; doc: the text of each item."""
    time = np.full(n_docs * m, np.inf)
    kept = np.zeros(n_docs * m, np.uint64)
    mass = np.bincount(doc, weights, n_docs)
    # About as many arrivals as come until all registers of the text are taken.
    burst = np.ceil(1.1 * m * np.log(m) * weights / mass[doc]).astype(np.int64)
    last, done = np.zeros(len(items)), np.zeros(len(items), np.int64)
    act = np.arange(len(items))
    while len(act):
        k = burst[act]
        end = np.cumsum(k)
        of = np.repeat(act, k)
        nth = np.arange(end[-1]) - np.repeat(end - k, k) + done[of]
        z = _mix(items[of] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((z >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[of]
        total = np.cumsum(gap)
        base = np.concatenate(([0.0], total[end[:-1] - 1]))
        t = total - np.repeat(base - last[act], k)
        at = doc[of] * m + ((_mix(z ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        near = np.flatnonzero(t < time[at])
        np.minimum.at(time, at[near], t[near])
        won = near[t[near] == time[at[near]]]
        kept[at[won]] = items[of[won]]
        last[act] = t[end - 1]
        done[act] += k
        act = act[last[act] < time.reshape(n_docs, m).max(1)[doc[act]]]
    return kept.reshape(n_docs, m)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    h = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(registers), 1))
    r = registers.reshape(len(registers), bands, rows)
    for k in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + r[:, :, k])
    return h.view(np.int64)


def similarity(a: np.ndarray, u: np.ndarray, b: np.ndarray, v: np.ndarray) -> float:
    """Probability Jaccard of two weighted sets (sorted items, weights), or the Jaccard of the sets if that is more."""
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    plain = len(both) / (len(a) + len(b) - len(both))
    if plain >= SIMILARITY or (u == 1).all() and (v == 1).all():
        return plain
    x = np.concatenate((u[ia], np.delete(u, ia), np.zeros(len(b) - len(both)))).astype(float)
    y = np.concatenate((v[ib], np.zeros(len(a) - len(both)), np.delete(v, ib))).astype(float)
    # sum over j of max(x_j / x_i, y_j / y_i): items with a larger x/y than i count by x, the others by y
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    low = np.concatenate(([0.0], np.cumsum(y[order])))
    high = np.concatenate(([0.0], np.cumsum(x[order])))
    n = len(both)
    at = np.searchsorted(ratio[order], ratio[:n], side="left")
    return max(plain, float((1 / (low[at] / y[:n] + (high[-1] - high[at]) / x[:n])).sum()))


def _nodes(docs: DataFrame) -> DataFrame:
    """docs with node: a 128-bit hash of the text, null for texts without words."""
    blank = F.coalesce(F.btrim("text", F.lit(SPACES)), F.lit("")) == ""
    return docs.select("doc_id", "text", F.when(~blank, F.unhex(F.md5(F.col("text").cast("binary")))).alias("node"))


def bitmap(items: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """(n_docs, 64 * LONGS): the bits of the texts' shingles."""
    flags = np.zeros((n_docs, 64 * LONGS), bool)
    flags[doc, ((_mix(items) >> np.uint64(32)) * np.uint64(64 * LONGS) >> np.uint64(32)).astype(np.int64)] = True
    return flags


def signatures(nodes: DataFrame) -> DataFrame:
    """(node, keys) and SIGNATURE: the band keys of each text, of both its sketches, its bitmap, the ones in that, and its shingles, distinct and all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                sets = [shingles(t) for t in as_bytes(b.column(1))]
                doc = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
                items, counts = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
                keys = list(band_keys(sketch(items, counts.astype(float), doc, len(sets))))
                again = [i for i, s in enumerate(sets) if (s[1] > 1).any()]
                if again:
                    own = [sets[i][0] for i in again]
                    of = np.repeat(np.arange(len(again)), [len(x) for x in own])
                    plain = band_keys(sketch(np.concatenate(own), np.ones(len(of)), of, len(again)))
                    for i, k in zip(again, plain, strict=True):
                        keys[i] = np.unique(np.concatenate((keys[i], k)))
                ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                flags = bitmap(items, doc, len(sets))
                words = np.packbits(flags, axis=1).view(np.int64).T
                sums = [x.astype(np.int32) for x in (flags.sum(1), np.bincount(doc, None, len(sets)), np.bincount(doc, counts, len(sets)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))), *map(pa.array, map(np.ascontiguousarray, words)), *map(pa.array, sums)], ["node", "keys", *SIGNATURE])

    bits = ", ".join(f"{c} long" for c in SIGNATURE[:LONGS])
    return nodes.where("node IS NOT NULL").select("node", "text").mapInArrow(run, f"node binary, keys array<long>, {bits}, ones int, size int, mass int")


def may_link(other: str) -> Column:
    """False only if two signatures rule out a similarity of SIMILARITY: the columns of SIGNATURE, and those of the other text, with a prefix.

    A bit that one bitmap has alone is at least one shingle that the other text doesn't have. That bounds the
    Jaccard of the sets; and the probability Jaccard is at most the share of either text's mass that the other text
    has. Both bounds are given as the bits that the bitmaps must have in common.
    """
    a, b = ({c: F.col(f"{x}{c}") for c in SIGNATURE} for x in ("", other))
    sets = (a["size"] + b["size"]) * F.lit(SIMILARITY / (1 + SIMILARITY)) - F.least(a["size"] - a["ones"], b["size"] - b["ones"])
    masses = F.greatest(*[x["ones"] - x["mass"] * F.lit(1 - SIMILARITY) for x in (a, b)])
    need = F.when((a["mass"] == a["size"]) & (b["mass"] == b["size"]), sets).otherwise(F.least(sets, masses)) - 1e-6
    common = sum((F.bit_count(a[f"bits{i}"].bitwiseAND(b[f"bits{i}"])) for i in range(1, LONGS)), F.bit_count(a["bits0"].bitwiseAND(b["bits0"])))
    return (F.least(a["ones"], b["ones"]) >= need) & (common >= need)


def weighted_sets(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s, c): shingles and counts (empty: all 1) of the wanted nodes, from one row of each. wanted: (node)."""
    first = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    first = first.join(wanted, "node", "left_semi").select(F.col("node").alias("w"), "first")
    a = nodes.withColumn("x", F.xxhash64("node", "doc_id"))
    b = first.withColumn("y", F.xxhash64("w", "first"))
    one = a.join(b, (F.col("x") == F.col("y")) & (F.col("node") == F.col("w")) & same(F.col("doc_id"), F.col("first"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            out = []
            for node, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if node not in seen:
                    seen.add(node)
                    s, c = shingles(text)
                    out.append((node, s.tobytes(), b"" if (c == 1).all() else c.astype(np.uint32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], ["node", "s", "c"])

    return one.mapInArrow(run, "node binary, s binary, c binary")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is SIMILARITY at least."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for sa, ca, sb, cb in zip(*(b.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                u = np.frombuffer(ca, np.uint32) if ca else np.ones(len(x), np.uint32)
                v = np.frombuffer(cb, np.uint32) if cb else np.ones(len(y), np.uint32)
                ok.append(similarity(x, u, y, v) >= SIMILARITY)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = hot_join(hot_join(pairs, left, ["a"]), right, ["b"]).select("a", "b", "sa", "ca", "sb", "cb")
    return held.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): one vertex for each component, by the smallest label among neighbours, in the order of the vertices' hashes.

    Links go to a few leaders, so most labels arrive in the first rounds. From the fourth round on labels are also looked up once more (pointer jumping), so that long chains take a
    logarithmic number of rounds. Each round is written out.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    mark = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    at = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min(mark("b")), F.first(mark("a"))).alias("l")))
    for turn in range(1 << 30):
        near = hot_join(both, at.select(F.col("v").alias("b"), "l"), ["b"]).select(F.col("a").alias("v"), "l", F.lit(None).cast(at.schema["l"].dataType).alias("was"))
        new = near.union(at.select("v", "l", F.col("l").alias("was"))).groupBy("v").agg(F.min("l").alias("l"), F.min("was").alias("was"))
        if turn >= 3:
            up = at.select(F.col("v").alias("top"), F.col("l").alias("up"))
            new = hot_join(new.withColumn("top", F.col("l.v")), up, ["top"]).select("v", F.least("l", "up").alias("l"), "was")
        new = materialize(new)
        discard(at)
        at = new
        if at.where("l <> was").isEmpty():
            discard(both)
            return at.select("v", F.col("l.v").alias("root"))


def _pair(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _renamed(df: DataFrame, root: DataFrame) -> DataFrame:
    """df with its labels replaced by those of root (v, root), where they are there."""
    to = root.select(F.col("v").alias("label"), "root")
    return hot_join(df, to, ["label"], "left").withColumn("label", F.coalesce("root", "label")).drop("root")


def _open(now: DataFrame) -> DataFrame:
    """Members of the buckets that have two classes or more."""
    several = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return hot_join(now, several, ["key"])


def classes(nodes: DataFrame) -> DataFrame:
    """(node, label): the class of each node that shares a bucket; label is a node. Others are left out."""
    sigs = materialize(signatures(nodes).groupBy("node").agg(*[F.first(c).alias(c) for c in ("keys", *SIGNATURE)]))
    bands = sigs.select("node", F.explode("keys").alias("key"))
    shared = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = materialize(hot_join(bands, shared, ["key"]).select("key", "node", "n"))
    # How many others a text meets in all its buckets: an original meets more than its copies, each of which has left some.
    met = held.groupBy("node").agg(F.sum("n").alias("met"))
    members = materialize(hot_join(held.select("key", "node"), met, ["node"]).select("key", "node", "met"))
    sets = materialize(weighted_sets(nodes, met.select("node")))
    # One leader for each bucket: the text that meets most others, so the same one wherever it can be.
    best = F.max(F.struct("met", F.xxhash64("node"), "node"))["node"].alias("lead")
    led = materialize(hot_join(members.select("key", "node"), members.groupBy("key").agg(best), ["key"]).where("node <> lead"))
    tested = materialize(led.select(*_pair("node", "lead")).distinct())
    label = met.select("node", F.col("node").alias("label"))
    now = led.select("key", "node", F.col("node").alias("label"))
    links = materialize(verify(tested, sets))
    if not links.isEmpty():
        root = components(links)
        label, now = _renamed(label, root), _renamed(now, root)
    label = materialize(label)
    # From here on now holds, for each open bucket, the members that have led no round.
    now = materialize(hot_join(_open(now).select("key", "node", "label"), sigs.drop("keys"), ["node"]))
    discard(held, members, led, links)
    target = LEADERS
    while True:
        sizes = now.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "label")).alias("m"))
        sizes = sizes.select("key", "all", F.col("m.label").alias("large"), (F.col("all") - F.col("m.n")).alias("rest"))
        rows, work = sizes.agg(F.sum("all"), F.sum(F.col("all").cast("double") * F.col("rest"))).first()
        if not rows:
            break
        last = work <= LINEAR * rows  # all members of all but the largest class lead: what is left is compared at once
        u = F.pmod(F.xxhash64(F.lit(target), "key", "node"), F.lit(1 << 30)) / float(1 << 30)
        chosen = (F.col("label") != F.col("large")) & (F.lit(last) | (u * F.col("rest") < target))
        marked = materialize(hot_join(now, sizes, ["key"]).withColumn("leads", chosen).select("key", "node", "label", *SIGNATURE, "leads"))
        leads = marked.where("leads").select("key", F.col("node").alias("lead"), F.col("label").alias("of"), *[F.col(c).alias(f"its_{c}") for c in SIGNATURE])
        pairs = hot_join(marked, leads, ["key"]).where((F.col("label") != F.col("of")) & (~F.col("leads") | (F.col("node") < F.col("lead"))) & may_link("its_"))
        pairs = materialize(pairs.select(*_pair("node", "lead")).distinct().join(tested, ["a", "b"], "left_anti"))
        named = label.select(F.col("node").alias("a"), F.col("label").alias("la")), label.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        links = hot_join(hot_join(verify(pairs, sets), named[0], ["a"]), named[1], ["b"]).where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        links = materialize(links)
        rest = marked.where("NOT leads").drop("leads")
        if not links.isEmpty():
            root = components(links)
            label, rest = materialize(_renamed(label, root)), _renamed(rest, root)
        if last:
            break
        tested, target, old = materialize(tested.union(pairs)), target * TIMES, now
        now = materialize(_open(rest).select("key", "node", "label", *SIGNATURE))
        discard(old, marked, pairs, links)
    discard(sigs, sets, tested, now)
    return label


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class of near copies), class_size, keep (it is that document).

    Texts without words (null, empty, white space) have no near copies: each is a class of its own.
    Equal texts are of one class. A null id is never the smallest unless all of a class are null.
    Repeated rows each get their row. Whole texts are compared, however long. An empty table gives an empty one;
    only doc_id and text are read, so other columns can't clash.
    """
    nodes = _nodes(texts(docs))
    label = classes(nodes)
    named = hot_join(nodes.select("doc_id", "node"), label, ["node"], "left").select("doc_id", F.coalesce("label", "node").alias("cls"))
    named = materialize(named)
    per = named.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = hot_join(named, per, ["cls"], "left")
    alone = F.col("cls").isNull()
    out = out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    return out.withColumn("keep", same(F.col("doc_id"), F.col("class_id")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each class: that with the smallest id (and of its texts the smallest hash), one row of it.

    A null id comes after all others. Texts without words (null, empty, white space) stay, every row of them. Whole texts
    are compared, however long. An empty table gives an empty one; other columns pass through whatever their names.
    """
    nodes = _nodes(texts(docs, id_col, text_col))
    named = hot_join(nodes.select("doc_id", "node"), classes(nodes), ["node"], "left").where("node IS NOT NULL").select("doc_id", "node", F.coalesce("label", "node").alias("cls"))
    named = materialize(named)
    me = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    per = named.groupBy("cls").agg(F.min(me).alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = hot_join(named, per, ["cls"]).withColumn("kept", me == F.col("one"))
    i, h, k = (fresh(docs, x) for x in ("near_doc", "near_text", "near_kept"))
    # Rows of the same document, id and text, more than once: one of them is kept.
    again = held.groupBy("doc_id", "node").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    again = materialize(again.where("NOT kept OR n > 1").select(F.col("doc_id").alias(i), F.col("node").alias(h), F.col("kept").alias(k)))
    mark = F.unhex(F.md5(F.col(text_col).cast("binary")))
    on = same(F.col(id_col), F.col(i)) & (mark == F.col(h))
    out = docs.join(again.where(~F.col(k)), on, "left_anti")
    twice = again.where(F.col(k))
    if twice.isEmpty():
        return out
    single = out.join(twice, on, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(twice, on, "left_anti").unionByName(single)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
