"""Quality, language and toxicity: contracts, brute force of what can be computed, held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvjoin.llm import language, quality, textstats, toxicity
from kvjoin.llm.common import texts

SF = "/root/testdata/sf0.01"


def remainder(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 4


# Quality
def brute_stats(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    seen, twice = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            twice |= {i + k for i in at for k in range(8)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.strip(" \t\n\r\x0b\x0c"):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(twice)


def test_base(edge, edge_rows, spark):
    rng = random.Random(1)
    extra = [(100 + i, " ".join(rng.choice(["a", "b", "é#", "c|"]) for _ in range(rng.randrange(80))) + "\n" * (i % 3) + "a b\x0b c d\x1ce") for i in range(40)]
    docs = [(r[0], r[1]) for r in edge_rows] + extra
    forest = quality.fit(np.zeros((0, len(textstats.FEATURES))), np.zeros(0))
    got = quality.score(spark.createDataFrame(docs, "doc_id long, text string"), forest).collect()
    want = Counter()
    for d, t in docs:
        s = brute_stats(t)
        failed = s[0] < 20 or 100 * s[4] > 30 * s[0]
        want[(d, *s, failed, not failed)] += 1
    assert Counter(tuple(r)[:8] for r in got) == want


def test_quality_by_brute_force(edge, edge_rows):
    """Score and verdict against a recursive walk of each tree."""
    rng = np.random.default_rng(7)
    x = rng.random((2000, len(textstats.FEATURES))) * 3
    forest = quality.fit(x, (x[:, 2] - x[:, 9] + rng.random(2000) < 0.5).astype(float))

    def walk(at, v):
        if forest.left[at] < 0:
            return forest.value[at]
        return walk(forest.left[at] if v[forest.feature[at]] <= forest.threshold[at] else forest.right[at], v)

    want = Counter()
    for r in edge_rows:
        base, v = textstats.stats(None if r[1] is None else r[1].encode())
        p = 1 / (1 + np.exp(-(forest.base + sum(walk(root, v) for root in forest.roots))))
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        want[r[0], round(p, 9), failed, not failed and p >= quality.KEEP] += 1
    got = quality.score(texts(edge), forest).collect()
    assert Counter((r["doc_id"], round(r["score"], 9), r["base_failed"], r["kept"]) for r in got) == want


def test_quality_sample(edge, nothing, spark):
    """Null, missing, repeated and unknown labels; the sample doesn't depend on the layout."""
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (2, 0), (5, 1), (None, 1), (999, 1), (3, 0), (3, 0)], "doc_id long, quality int")
    one = quality.sample(texts(edge), labels)
    other = quality.sample(texts(edge.repartition(1)), labels.repartition(5))
    assert one[1].tolist() == [1, 0, 0, 1] and all((a == b).all() for a, b in zip(one, other, strict=True))
    for docs, lab in ((nothing, labels), (edge, labels.limit(0))):
        x, y = quality.sample(texts(docs), lab)
        assert x.shape == (0, len(textstats.FEATURES)) and len(y) == 0
        assert quality.score(texts(docs), quality.fit(x, y)).count() == docs.count()


def test_trees_are_monotone_and_right():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(textstats.FEATURES)))
    y = (x[:, 0] + 0.3 * x[:, 8] + 0.1 * rng.random(3000) < 0.6).astype(float)
    forest = quality.fit(x, y)
    p = forest.score(x)
    assert ((p >= 0.5) == y).mean() > 0.93
    for j, m in enumerate(textstats.MONOTONE):
        if m:
            z = np.repeat(x[:50], 21, 0)
            z[:, j] = np.tile(np.linspace(-0.1, 1.1, 21), 50)
            assert (np.diff(forest.score(z).reshape(50, 21), axis=1) * m >= -1e-12).all()


def test_quality_query(spark):
    q = quality.query(spark, SF).cache()
    lab = spark.read.parquet(f"{SF}/labels.parquet")
    bad, good = (q.join(lab.where(f"quality = {k}"), "doc_id").where("NOT base_failed") for k in (0, 1))
    assert q.count() == 1000 and q.where("base_failed AND kept").isEmpty()
    assert bad.where("kept").count() <= 0.1 * bad.count() and good.where("kept").count() >= 0.95 * good.count()


# Language
def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    q = language.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(q) > 200 and sum(r["lang"] == r["lang_pred"] for r in q) / len(q) > 0.97
    assert all(0 <= r["score"] <= 1 for r in q)


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(2)
    sounds = {"en": "the and ing er wh", "de": "sch ung der ich ä", "fr": "eau que ée oi ç", "xx": "zz qq vv ww jj"}
    rows = [(i, " ".join("".join(rng.choice(sounds[k].split()) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(list(sounds) * 60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_families(tongues, spark, edge, edge_rows, nothing):
    model = language.fit(*language.sample(tongues))
    assert model.families == {"germanic": ["de", "en"], "romance": ["fr"], "only xx": ["xx"]} and set(model.pair) == {("de", "en")}
    got = language.predict(texts(tongues), model).join(tongues.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)
    assert all(r["held_out"] == (remainder(r["doc_id"]) == 2) for r in got)
    e = language.predict(texts(edge), model).collect()
    assert len(e) == len(edge_rows)
    und = {r["doc_id"] for r in e if r["lang_pred"] == "und"}
    assert und == {r[0] for r in edge_rows if not any(c.isalpha() for c in r[1] or "")}
    assert language.predict(texts(nothing), model).count() == 0
    kept = language.keep_identified(edge, model, 0.0)
    assert kept.columns == edge.columns and kept.count() == len(edge_rows) - len(und)


def test_language_without_training(nothing, edge):
    model = language.fit(*language.sample(nothing))
    assert {r["lang_pred"] for r in language.predict(texts(edge), model).collect()} == {"und"}
    one = language.fit(*language.sample(edge.where("lang = 'en'").withColumn("doc_id", F.lit(1).cast("long"))))
    assert {r["lang_pred"] for r in language.predict(texts(edge), one).collect()} == {"en", "und"}


def test_language_ignores_held_out(tongues):
    a = language.sample(tongues)
    b = language.sample(tongues.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))))
    assert (a[0] == b[0]).all() and list(a[1]) == list(b[1])


def test_language_by_brute_force(tongues):
    """Predictions against plain loops over the fitted machines: one-versus-rest for the family, then a vote of each pair."""
    model = language.fit(*language.sample(tongues))
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language.predict(texts(tongues), model).collect()}
    seen = 0
    for r in tongues.select("doc_id", "text").limit(150).collect():
        text = (r["text"] or "").encode()
        if not language.has_letter(text):
            assert got[r["doc_id"]] == ("und", 0)
            continue
        v = language.vector(text).astype(float)
        prob = lambda m: 1 / (1 + np.exp(-min(max(m.slope * (float(np.dot(v, m.w)) + m.b) + m.shift, -30), 30)))
        names = sorted(model.families)
        p = [prob(model.family[f]) for f in names] if len(names) > 1 else [1.0]
        best = max(range(len(names)), key=lambda i: p[i])
        langs, score = model.families[names[best]], p[best] / sum(p)
        votes, mass = Counter(), Counter()
        for i, a in enumerate(langs):
            for b in langs[i + 1 :]:
                q = prob(model.pair[a, b])
                votes[a if q >= 0.5 else b] += 1
                mass[a] += q
                mass[b] += 1 - q
        win = max(langs, key=lambda x: (votes[x] + 1e-3 * mass[x], -langs.index(x)))
        if len(langs) > 1:
            score *= mass[win] / (len(langs) - 1)
        assert got[r["doc_id"]][0] == win and got[r["doc_id"]][1] == pytest.approx(score, abs=1e-4)
        seen += 1
    assert seen > 50


def test_language_sample_is_bounded(spark, monkeypatch):
    """Rows equal in id and text, a hot language, and more languages than ever had a cap."""
    monkeypatch.setattr(language, "MAX_PER_LANG", 7)
    monkeypatch.setattr(language, "held_out", lambda c: F.lit(False))
    rows = [(1, "the same words here", "hot")] * 300 + [(i, f"words and {'abcdefghij'[i % 10] * 3}", "hot") for i in range(900)] + [(5000 + i, "uno dos tres", f"l{i % 130}") for i in range(520)]
    x, y = language.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n = Counter(y)
    assert len(n) == 131 and max(n.values()) <= 14 and n["hot"] == 14 and len(x) == len(y)


# Toxicity
def small_index(n=300, seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}".encode().replace(b"0", b"a") for i in range(60)]
    names = [bytes(97 + (i // 26**k) % 26 for k in (2, 1, 0)) for i in range(60)]
    del vocab
    bags = [Counter(rng.choices(names, k=rng.randrange(0, 12))) for _ in range(n)]
    y = np.array([int(names[3] in b or rng.random() < 0.05) for b in bags])
    return toxicity.build(list(range(1000, 1000 + n)), bags, y, names, np.arange(1, 61).astype(float), 500, y.mean()), bags, names


def test_search_is_exact_and_prunes():
    index, bags, names = small_index()
    dense = np.zeros((len(bags), 60))
    for e, bag in enumerate(bags):
        for w, c in bag.items():
            dense[e, names.index(w)] = (1 + np.log(c)) * index.idf[names.index(w)]
    dense /= np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-12)
    place = np.argsort(index.rank)  # of the bags
    rng = random.Random(9)
    queries = [index.query(sorted(Counter(rng.randrange(60) for _ in range(rng.randrange(1, 6))).items())) for _ in range(450)]
    skip = [rng.randrange(len(bags)) for _ in queries]
    for left_out in (None, [int(place[e]) for e in skip]):
        found = index.search(queries, skip=left_out)
        assert index.visited < len(queries) * len(index.dense)
        for (t, q), got, e in zip(queries, found, skip, strict=True):
            cos = (dense[:, t] @ q).round(12)
            if left_out:
                cos[e] = 0
            order = sorted((i for i, c in enumerate(cos) if c > 1e-12), key=lambda i: (-cos[i], i))
            assert [g[0] for g in got] == pytest.approx([cos[i] for i in order[: toxicity.K]], abs=1e-9)
            sure = {i for i in order[: toxicity.K] if abs(cos[i] - got[-1][0]) > 1e-9}
            assert sure <= {int(index.rank[j]) for _, j in got}


def test_toxicity_query(spark):
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.query(spark, "/root/testdata/sf0.1").join(lab.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit / sum(r["toxic"] for r in got) > 0.8 and hit / sum(r["predicted"] for r in got) > 0.8
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_toxicity_query_by_brute_force(spark):
    """The query against plain dictionaries: weights, all cosines, votes, calibration with each example left out."""
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lab = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if remainder(r["doc_id"]) != 2}
    bag = {i: Counter("".join(c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in t).split(" ")) for i, t in docs.items()}
    for b in bag.values():
        del b[""]
    known = sorted(i for i in lab if i in docs)
    df, own, bad = Counter(), Counter(), Counter()
    for b in bag.values():
        df.update(b.keys())
    for i in known:
        own.update(bag[i].keys())
        bad.update(bag[i].keys() if lab[i] else ())
    n, pos = len(known), sum(lab[i] for i in known)

    def weight(w):
        a, b = bad[w], own[w] - bad[w]
        down = own[w] * (n - own[w]) * pos * (n - pos)
        chi2 = n * (a * (n - pos - b) - b * (pos - a)) ** 2 / max(down, 1e-9)
        return (np.log((1 + len(docs)) / (1 + df[w])) + 1) * (chi2 / (chi2 + toxicity.MIN_CHI2) + toxicity.FLOOR)

    weights = {w: weight(w) for w in own}

    def vector(b):
        v = {w: (1 + np.log(c)) * weights[w] for w, c in b.items() if w in weights}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    vectors = {i: vector(bag[i]) for i in docs}

    def nearest(i, skip=None):
        cos = {e: round(sum(x * vectors[e].get(w, 0) for w, x in vectors[i].items()), 12) for e in known if e != skip}
        return sorted(((-c, e) for e, c in cos.items() if c > 0))[: toxicity.K]

    vote = lambda near: sum(-c * lab[e] for c, e in near) / sum(-c for c, _ in near)
    near = {e: nearest(e, e) for e in known}
    told = [e for e in known if near[e]]
    share = sum(lab.values()) / len(lab)
    w = np.array([share / pos if lab[e] else (1 - share) / (n - pos) for e in told])
    slope, shift = toxicity._platt(np.array([vote(near[e]) for e in told]), np.array([lab[e] for e in told]), w)
    silent = 0
    for r in toxicity.query(spark, sf).collect():
        got = nearest(r["doc_id"])
        silent += not got
        if got:
            assert r["score"] == pytest.approx(1 / (1 + np.exp(-(slope * vote(got) + shift))), abs=1e-6)
            assert r["nearest"][:1] == [got[0][1]] or got[0][0] == pytest.approx(got[1][0], abs=1e-9)
    assert silent <= 0.05 * len(docs)


def test_toxicity_edges(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame([(i, None if i == 4 else 1, None if i == 5 else i % 2) for i in range(19)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for docs, lab in ((edge, labels), (edge, labels.limit(0)), (nothing, labels)):
        index = toxicity.fit(texts(docs), lab)
        got = toxicity.score(texts(edge), index).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in edge_rows)
        assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(texts(nothing), index).count() == 0
    flipped = labels.withColumn("toxic", F.when(language.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.score(texts(edge), toxicity.fit(texts(edge), x)).collect() for x in (labels, flipped))
    assert Counter(map(str, a)) == Counter(map(str, b))


def test_toxicity_searches_every_text(spark):
    """Too few examples for a telling term: still, a copy of a toxic one is searched for and found."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [(i, " ".join("".join(rng.choices(letters, k=7)) for _ in range(30))) for i in range(40)]
    learned = [i for i, _ in docs if remainder(i) != 2]
    toxic = set(learned[:3])
    docs += [(1000 + i, t) for i, t in docs if i in toxic]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in learned], "doc_id long, toxic int")
    df = texts(spark.createDataFrame(docs, "doc_id long, text string"))
    index = toxicity.fit(df, labels)
    assert not index.telling
    got = {r["doc_id"]: r for r in toxicity.score(df, index).collect()}
    assert all(got[1000 + i]["nearest"][0] == i for i in toxic)


def test_toxicity_merges_no_terms():
    """Unrelated words with the same first four bytes and equal counts in either class are terms of their own."""
    bags = [Counter({"даром".encode(): 1}), Counter({"давно".encode(): 1}), Counter(other=1)]
    bags = [Counter({w if isinstance(w, bytes) else w.encode(): n for w, n in b.items()}) for b in bags] * 60
    y = np.array([1, 1, 0] * 60)
    terms = toxicity.vocabulary(bags)
    index = toxicity.build(list(range(180)), bags, y, terms, np.full(len(terms), 60.0), 180, y.mean())
    for w in ("даром", "давно"):
        assert w in index.score([w.encode()])[0][2] and index.score([w.encode()])[0][0] > 0.5
