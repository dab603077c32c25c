"""License scan, decontamination, mixing and line dedup against brute force."""

import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

import pytest

from kvjoin.llm import decontaminate, license_scan, line_dedup, mixing
from kvjoin.llm.common import texts


def rows(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


# Decontamination
def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items):
    win = defaultdict(set)
    for item, text in items:
        w = tokens(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if n else 0):
            win[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, ids = tokens(text), set(), set()
        for n in {len(k) for k in win}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in win:
                    hit |= set(range(i, i + n))
                    ids |= win[k]
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return Counter(tuple(map(str, r)) for r in out)


@pytest.fixture(scope="module")
def bench(spark, edge_rows):
    passage = edge_rows[18][1]
    items = [(1, passage.upper()), (2, "déjà vu"), (3, None), (4, "!!"), (None, passage), (5, "ONE"), (10, " ".join(passage.split()[5:15])), (10, passage), (7, "É accented Déjà")]
    return items, spark.createDataFrame(items, "item_id long, text string")


def test_decontamination(spark, edge, edge_rows, bench, nothing):
    items, df = bench
    docs = [(r[0], r[1]) for r in edge_rows]
    assert rows(decontaminate.report(texts(edge), df)) == brute_hits(docs, items)
    assert rows(decontaminate.report(texts(edge), df.limit(0))) == brute_hits(docs, [])
    assert decontaminate.report(texts(nothing), df).count() == 0


def test_decontamination_by_shuffle(edge, bench, monkeypatch):
    want = rows(decontaminate.report(texts(edge), bench[1]))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows(decontaminate.report(texts(edge), bench[1])) == want


def test_decontamination_removes(edge, edge_rows, bench):
    items, df = bench
    hit = {r: int(r[2]) > 0 for r in brute_hits([(r[0], r[1]) for r in edge_rows], items)}
    assert any(hit.values())
    out = decontaminate.decontaminate(edge, df)
    assert out.columns == edge.columns
    clean = Counter(r[0] for r in edge_rows if not next(iter(brute_hits([(r[0], r[1])], items)))[2] != "0")
    assert Counter(r["doc_id"] for r in out.collect()) == clean
    spans = decontaminate.decontaminate(edge, df, remove="spans")
    assert spans.count() == len(edge_rows) and spans.columns == edge.columns
    assert {r["text"] for r in spans.where("doc_id = 18").collect()} == {""}
    assert {r["text"] for r in spans.where("doc_id = 1").collect()} == {edge_rows[1][1]}


# License scan
def brute_license(text):
    known = {license_scan.normal(s): k for k, s in license_scan.SENTENCES.items()}
    ss = [x for s in re.sub(r"([.;:!?])[ \t\r]+", r"\1\n", text or "").split("\n") if (x := license_scan.normal(s))]
    seq = "".join(f"<{known[s]}>" for s in ss if s in known)
    n_known, n, names = sum(s in known for s in ss), 0, []
    for name, ids in license_scan.RULES:
        p = "".join(f"<{x}>" for x in ids)
        if p in seq:
            n += seq.count(p)
            names += [name] * (name not in names)
            seq = seq.replace(p, "|")
    return len(ss), n_known, n, ",".join(names), seq.replace("|", "")


def test_licenses(spark, edge, edge_rows, nothing):
    s = license_scan.SENTENCES
    extra = [
        " ".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        "\n".join(s[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")) + "\n" + s["mit-short"],
        f"{s['mit-short']} {s['mit-short']} {s['gpl-see']}",
        f"# {s['apache-named']}\n# {s['apache-not-use']} unknown words here. {s['apache-copy']}",
        s["cc-by-nc-4"].upper(),
    ]
    docs = [(r[0], r[1]) for r in edge_rows] + [(100 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(license_scan.scan(df)) == Counter(tuple(map(str, (d, *brute_license(t)))) for d, t in docs)
    assert [r["licenses"] for r in license_scan.scan(df).where("doc_id >= 100").orderBy("doc_id").collect()] == ["BSD-3-Clause", "MIT,BSD-2-Clause", "MIT", "Apache-2.0", "CC-BY-NC-4.0"]
    assert license_scan.scan(nothing).count() == 0


def test_every_license_rule(spark):
    """Each rule's own sentences, put together, give its licence; also those with a break of sentences inside."""
    s = license_scan.SENTENCES
    docs = [(2 * i + k, sep.join(s[x] for x in ids)) for i, (_, ids) in enumerate(license_scan.RULES) for k, sep in enumerate(("\n", "\n\n"))]
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_known"], r["n_matches"], r["unmatched"]) for r in got] == [(name, len(ids), 1, "") for name, ids in license_scan.RULES for _ in range(2)]


@pytest.mark.parametrize("mark, end", [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("    ", "\n")])
def test_wrapped_licenses(spark, mark, end):
    s, rules = license_scan.SENTENCES, license_scan.RULES
    docs = []
    for i, (_, ids) in enumerate(rules):
        for width in (30, 50, 72):
            notice = "".join(mark + x + end for k in ids for x in textwrap.wrap(s[k], width, break_long_words=False, break_on_hyphens=False))
            docs.append((i, f"{mark}Copyright 2020 A. Person{end}{mark}{end}{notice}{mark}{end}import this{end}"))
    header = "Licensed under the Apache License, Version 2.0 (the \"License\");|you may not use this file except in compliance with the License.|You may obtain a copy of the License at||    http://www.apache.org/licenses/LICENSE-2.0||Unless required by applicable law or agreed to in writing, software|distributed under the License is distributed on an \"AS IS\" BASIS,|WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.|See the License for the specific language governing permissions and|limitations under the License."
    docs.append((0, "".join(mark + x + end for x in header.split("|"))))
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["licenses"], r["n_known"], r["n_matches"], r["unmatched"]) for r in got) == Counter((i, rules[i][0], len(rules[i][1]), 1, "") for i, _ in docs)


def test_license_oracle_on_wrapped_texts(spark):
    """The SQL oracle and the operator agree on sentences in pieces, next to each other and repeated."""
    import duckdb

    s, rules = license_scan.SENTENCES, license_scan.RULES
    docs = [(i, "\n".join("# " + x for k in ids for x in textwrap.wrap(s[k], 50)) + f"\n{s['mit-short']} {s['mit-short']}\n{s['gpl-see']}") for i, (_, ids) in enumerate(rules)]
    docs += [(1000, None), (1001, ""), (1002, " ".join(s.values()))]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"))
    cur = con.execute(f"SELECT {', '.join(got.columns)} FROM ({license_scan.ORACLE})")
    assert rows(got) == Counter(tuple(map(str, r)) for r in cur.fetchall())


# Mixing
def brute_mix(docs, weights, seed=mixing.SEED):
    n = Counter(s for _, s in docs)
    w = {s: (weights.get(s, 0.0) if weights is not None else n[s] ** mixing.ALPHA) for s in n}
    total = sum(w.values())
    out = Counter()
    for doc, s in docs:
        rate = w[s] / total * len(docs) / n[s] if total else 0
        name = "" if doc is None else str(doc)
        u = int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:12], 16) / 16**12
        k, cdf = 0, math.exp(-rate)
        p = cdf
        while u >= cdf and k < 400 and rate:
            k += 1
            p *= rate / k
            cdf += p
        out[(doc, s)] += k if rate else 0
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0}, {"a": 1.0}, {}])
def test_mixing(edge, edge_rows, weights):
    out = mixing.mix(edge, weights)
    assert out.columns == edge.columns
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == brute_mix([(r[0], r[3]) for r in edge_rows], weights)


def test_mixing_large_rates_and_totals(spark, nothing):
    df = spark.range(200).selectExpr("id AS doc_id", "'t' AS text", "if(id < 2, 'small', 'big') AS source")
    out = mixing.mix(df, {"small": 1.0, "big": 1e-9}, total=4000, details=True)
    n = {r["doc_id"]: r["n_copies"] for r in out.select("doc_id", "n_copies").distinct().collect()}
    assert set(n) == {0, 1} and all(abs(n[i] - 2000) < 300 for i in (0, 1))
    mean = mixing.mix(spark.range(4000).selectExpr("id AS doc_id", "'s' AS source"), {"s": 1.0}, total=10000).count()
    assert abs(mean - 10000) < 500
    assert mixing.mix(nothing).count() == 0


def test_mixing_without_broadcast(edge, monkeypatch):
    want = rows(mixing.mix(edge))
    monkeypatch.setattr(mixing, "BROADCAST_ENTRIES", 0)
    assert rows(mixing.mix(edge)) == want


# Line dedup
def brute_lines(docs, n=line_dedup.MIN_RUN):
    """By distinct (id, text); ids in order, null first. Ties of ids are told apart by the text's hash, so callers leave them out."""
    firsts, gone = {}, defaultdict(set)
    order = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0))
    for doc, text in order:
        ls = [t for x in (text or "").split("\n") if (t := x.strip(" \t\r"))]
        for i in range(len(ls) - n + 1):
            k = tuple(ls[i : i + n])
            if firsts.setdefault(k, (doc, i)) != (doc, i):
                gone[doc, text] |= set(range(i, i + n))
    out = []
    for doc, text in docs:
        kept, i, g = [], 0, gone[doc, text]
        for x in (text or "").split("\n"):
            if not x.strip(" \t\r"):
                kept.append(x)
                continue
            if i not in g:
                kept.append(x)
            i += 1
        out.append((doc, i, len(g), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(tuple(map(str, r)) for r in out)


def test_line_dedup(spark, edge, nothing):
    a, b, c, d, e = ("first line", "second line", "third", "fourth", "fifth")
    texts_ = ["\n".join(x) for x in ([a, b, c, d], [e, b, c, d, "", a], [a, a, a, a, a], [b, "", c, d], [a, b], [e, a, b, c, d, e, b, c, d], [], [a, b, c, d], ["", " ", "\t"])]
    docs = list(enumerate(texts_)) + [(20, None), (3, texts_[3]), (None, "x\ny\nz"), (21, "x \n y\nz\r"), (22, "\n".join(f"l{i % 50}" for i in range(3000)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(line_dedup.report(df)) == brute_lines(docs)
    assert line_dedup.report(nothing).count() == 0
    out = line_dedup.dedup(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    left = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df, drop_emptied=True).collect()}
    assert 7 not in left and left[4] == texts_[4] and left[20] is None and left[0] == texts_[0]


def test_line_dedup_random(spark):
    import random

    rng = random.Random(5)
    docs = [(i, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for i in range(150)]
    assert rows(line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string"))) == brute_lines(docs)


def test_native_plans(edge, bench):
    for df in (license_scan.scan(edge), decontaminate.report(texts(edge), bench[1]), mixing.mix(edge), line_dedup.report(edge)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)


def test_decontaminate_paths_agree(spark, edge, edge_rows, monkeypatch):
    """Windows broadcast, hashes broadcast, and hashes shuffled give the same rows."""
    bench = spark.createDataFrame([(1, edge_rows[18][1]), (2, "déjà vu"), (3, "one"), (4, None), (5, edge_rows[0][1])], "item_id long, text string")
    rows = lambda: Counter(map(str, decontaminate.report(texts(edge), bench).collect()))
    want = rows()
    assert any("contaminated=True" in r for r in want)
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    assert rows() == want


def test_line_dedup_of_a_long_text(spark):
    """200,000 lines: linear, or this takes minutes."""
    lines = [f"line {i}" for i in range(100_000)]
    df = spark.createDataFrame([(1, "\n".join(lines + lines)), (2, "\n\n".join(["new", *lines[:7]]))], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup(df).collect()}
    assert out == {1: "\n".join(lines), 2: "new\n" + "\n" * 6}
