"""Near-dedup, substring dedup and WARC archives against brute force and round trips."""

import base64
import hashlib
import random
import struct
from collections import Counter

import numpy as np
import pytest
import zstandard
from conftest_words import prose

from kvjoin.llm import near_dedup, substring_dedup, warc
from kvjoin.llm.common import work_dir


# Near-dedup
def brute_classes(docs):
    """class_id by position: components over texts with words that are similar enough."""
    sets = [near_dedup.shingles((t or "").encode()) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and (docs[i][1] == docs[j][1] or near_dedup.similarity(*sets[i], *sets[j]) >= 0.8):
                root[find(i)] = find(j)
    out = Counter()
    for i, (doc, _) in enumerate(docs):
        group = [docs[j][0] for j in range(len(docs)) if find(j) == find(i)]
        ids = [g for g in group if g is not None]
        out[doc, min(ids) if ids and len(sets[i][0]) else doc, len(group)] += 1
    return out


def test_probability_jaccard():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(1, 30))], np.uint64)) for _ in range(2))
        u, v = (np.array([rng.randrange(1, 5) for _ in x]) for x in (a, b))
        x, y = dict(zip(a.tolist(), u, strict=True)), dict(zip(b.tolist(), v, strict=True))
        want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
        plain = len(x.keys() & y.keys()) / len(x.keys() | y.keys())
        got = near_dedup.similarity(a, u, b, v)
        assert got == pytest.approx(max(want, plain)) or got == plain >= 0.8


def test_sketch_estimates_it():
    rng = np.random.default_rng(3)
    items = rng.integers(1, 2**63, 300).astype(np.uint64)
    u, v = rng.integers(1, 4, 240).astype(float), rng.integers(1, 4, 240).astype(float)
    order = [np.argsort(x) for x in (items[:240], items[60:])]
    a, b = items[:240][order[0]], items[60:][order[1]]
    u, v = u[order[0]], v[order[1]]
    x, y = dict(zip(a.tolist(), u, strict=True)), dict(zip(b.tolist(), v, strict=True))
    want = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())
    m = 4000
    r = near_dedup.sketch(np.concatenate((a, b)), np.concatenate((u, v)), np.repeat([0, 1], [240, 240]), 2, m)
    assert abs((r[0] == r[1]).mean() - want) < 0.04
    one = near_dedup.sketch(a, u, np.zeros(240, int), 1, m)
    assert (one[0] == r[0]).all() and (one != 0).all()


def test_near_dedup(spark, edge, edge_rows, nothing):
    docs = [(r[0], r[1]) for r in edge_rows]
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.report(edge).collect())
    assert got == brute_classes(docs)
    assert near_dedup.report(nothing).count() == 0 and near_dedup.dedup(nothing).count() == 0
    out = near_dedup.dedup(edge)
    assert out.columns == edge.columns
    left = [(r["doc_id"], r["text"]) for r in out.collect()]
    words = [d for d in left if (d[1] or "").split()]
    assert len(left) - len(words) == sum(not (t or "").split() for _, t in docs)
    assert len(words) == len({c for d, c, n in brute_classes([d for d in docs if (d[1] or "").split() and d[0] is not None])}) + sum(
        d[0] is None and d[1] not in {t for i, t in docs if i is not None} for d in docs
    )
    assert (0, docs[0][1]) in words and (4, docs[4][1]) not in words and Counter(words).most_common(1)[0][1] == 1


def test_near_dedup_repeated_passage(spark):
    """Copies in which one passage is repeated: nearly the same sets, but low probability Jaccard."""
    rng = random.Random(12)
    docs = []
    for i in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(504)]
        docs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words + 40 * words[100:115]))]
        if i % 3 == 0:  # both texts with repeats, of other passages
            docs[-2] = (2 * i, " ".join(words + 40 * words[300:315]))
    got = Counter((r["doc_id"], r["class_id"]) for r in near_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == Counter((d, d - d % 2) for d, _ in docs)


def test_near_dedup_chain_and_group(spark):
    """A chain whose ends aren't similar, a group of many near copies, and passages shared by unlike texts."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    docs = []
    for i in range(12):  # each step changes two words more
        docs.append((i, " ".join(f"new{j}" if j in range(0, 9 * i, 9) else w for j, w in enumerate(base))))
    hot = prose(rng, 200).split()
    for i in range(60):
        w = list(hot)
        w[rng.randrange(200)] = f"edit{i}"
        docs.append((100 + i, " ".join(w)))
    shared = prose(rng, 30)
    docs += [(300 + i, f"{shared} {prose(rng, 80)}") for i in range(15)]
    got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute_classes(docs)


def test_near_dedup_hot_group(spark, monkeypatch):
    """Variants of one text at all similarities, and no original: all links of brute force are found, round by round and at once."""
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(160)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8])):
            w[rng.randrange(160)] = f"e{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    want = brute_classes(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for linear in (near_dedup.LINEAR, 0):
        monkeypatch.setattr(near_dedup, "LINEAR", linear)
        got = Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in near_dedup.report(df).collect())
        assert sum((got & want).values()) >= 0.99 * len(docs)


def test_bound_of_bitmaps():
    """may_link() in plain Python: it never rules out a pair that similarity() links."""
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(200) for _ in range(rng.randrange(5, 120))]
        b = a[: rng.randrange(3, len(a) + 1)] + [rng.randrange(200) for _ in range(rng.randrange(8))]
        (x, u), (y, v) = (np.unique(np.array(z, np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True) for z in (a, b))
        s = near_dedup.similarity(x, u, y, v)
        p, q = (near_dedup.bitmap(z, np.zeros(len(z), int), 1)[0] for z in (x, y))
        both, limit = int((p & q).sum()), near_dedup.SIMILARITY
        sets = (len(x) + len(y)) * limit / (1 + limit) - min(len(x) - p.sum(), len(y) - q.sum())
        masses = max(p.sum() - u.sum() * (1 - limit), q.sum() - v.sum() * (1 - limit))
        need = sets if (u == 1).all() and (v == 1).all() else min(sets, masses)
        assert s < limit or both >= need - 1e-6


# Substring dedup
def brute_substrings(docs, n=13):
    first = {}
    split = [(t or "").encode().split() for _, t in docs]
    rank = lambda d: (d is None, d or 0)
    for (d, _), w in zip(docs, split, strict=True):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k not in first or rank(d) < rank(first[k]):
                first[k] = d
    out = Counter()
    for (d, _), w in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if rank(first[tuple(w[i : i + n])]) < rank(d):
                gone |= set(range(i, i + n))
        out[d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()] += 1
    return out


def test_substrings(spark, edge, edge_rows, nothing, monkeypatch):
    docs = [(r[0], r[1]) for r in edge_rows]
    rng = random.Random(6)
    passages = [prose(rng, n) for n in (13, 14, 20, 60, 12)]
    docs += [(200 - i, " ".join([prose(rng, rng.randrange(20)), *rng.choices(passages, k=3), prose(rng, 5)])) for i in range(60)]
    docs += [(300, " ".join(["again and again"] * 40)), (301, " ".join(["again and again"] * 9)), (302, " ".join(["wide"] * 20) + " \x85 x")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = lambda: Counter(tuple(r) for r in substring_dedup.report(df).collect())
    want = brute_substrings(docs)
    assert got() == want
    monkeypatch.setattr(substring_dedup, "GROUP", 5)  # long prefixes
    assert got() == want
    monkeypatch.setattr(substring_dedup, "GROUP_WORDS", 20)  # many groups in a partition
    assert got() == want
    assert substring_dedup.report(nothing).count() == 0


def test_tree_nodes():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 3, 400).astype(np.uint32)
    s = np.lib.stride_tricks.sliding_window_view(words, substring_dedup.WINDOW)
    check = np.array([hash(x.tobytes()) & (2**63 - 1) for x in s], np.uint64)
    tree = substring_dedup.Tree(s, check)
    for depth in (1, 2, 5, 13):
        node = tree.nodes(depth)
        groups = {}
        for pos, k in zip(tree.order, node, strict=True):
            groups.setdefault(k, set()).add(tuple(s[pos][:depth]))
        assert all(len(g) == 1 for g in groups.values())
        assert len(groups) == len({tuple(x[:depth]) for x in s})


# WARC
def test_record_round_trip():
    for payload in (b"", b"x", "é\r\n\r\n".encode() * 50, bytes(range(256)) * 40):
        r = warc.Record(7, "http://a/\nb?é", "response", payload, len(payload), warc.digest(payload))
        back = warc.decode(warc.encode(r))
        assert (back.page_id, back.payload, back.payload_bytes, back.payload_digest) == (7, payload, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
    v = warc.Record(None, "", "revisit", None, 9, warc.digest(b"nine byte"), -3)
    back = warc.decode(warc.encode(v))
    assert (back.page_id, back.kind, back.payload_bytes, back.refers_to) == (None, "revisit", 9, -3)


def test_archive_frames():
    records = [warc.encode(warc.Record(i, f"http://x/{i}", "response", b"page %d " % i * 50, len(b"page %d " % i * 50), warc.digest(b"page %d " % i * 50))) for i in range(40)]
    d = warc.dictionary(records)
    archive = b"".join(warc.pack(records, d))
    assert list(warc.unpack(archive)) == records
    magic, n = struct.unpack_from("<II", archive)
    assert magic == 0x184D2A5D and zstandard.ZstdDecompressor().decompress(archive[8 : 8 + n]) == d
    plain = struct.pack("<II", magic, len(d)) + d + archive[8 + n :]  # the dictionary may also be stored as it is
    assert list(warc.unpack(plain)) == records
    for bad in (b"", archive[8 + n :], archive[:-3], archive[: 8 + n - 1], archive[:-20] + bytes(20)):
        with pytest.raises(warc.BadArchive):
            list(warc.unpack(bad))
    assert list(warc.unpack(b"".join(warc.pack([], warc.dictionary([]))))) == []


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"WARC/9"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r + b"x", lambda r: r.replace(b"hello", b"hallo"), lambda r: r.replace(b"WARC-Date", b"WARC-Data"), lambda r: r.replace(b"urn:page:1", b"urn:page:x")])
def test_bad_records(change):
    raw = warc.encode(warc.Record(1, "http://x", "response", b"hello", 5, warc.digest(b"hello")))
    warc.decode(raw)
    with pytest.raises(warc.BadArchive):
        warc.decode(change(raw))


def test_undecodable_header():
    raw = warc.encode(warc.Record(1, "http://x", "response", b"hello", 5, warc.digest(b"hello")))
    for change in (raw.replace(b"http://x", b"http://\xff"), raw.replace(b"Content-Length: ", "Content-Length: ²".encode(), 1)):
        with pytest.raises(warc.BadArchive):
            warc.decode(change)


def test_bad_archives_set_aside(spark, tmp_path):
    raw = [warc.encode(warc.Record(i, f"http://x/{i}", "response", b"page %d" % i, 6, warc.digest(b"page %d" % i))) for i in range(4)]
    packed = lambda rs: b"".join(warc.pack(rs, warc.dictionary(rs)))
    (tmp_path / "a.warc.zst").write_bytes(packed(raw[:1] + [raw[1].replace(b"page 1", b"page 9")] + raw[2:]))
    (tmp_path / "b.warc.zst").write_bytes(packed(raw)[:-5])
    with pytest.raises(Exception, match="BadArchive"):
        warc.read(spark, str(tmp_path)).collect()
    got = Counter(r["page_id"] for r in warc.read(spark, str(tmp_path), bad="keep").collect())
    assert got == {0: 2, 1: 1, 2: 2, 3: 1, None: 2}


def test_pages(spark, nothing):
    pages = [(5, "u", "same"), (3, "u", "same"), (9, None, "same"), (1, "u", ""), (2, "u", None), (4, "u", "é" * 30000), (None, "u", "same"), (None, "v", "alone"), (3, "u", "same"), (8, "u\n", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    directory = f"{work_dir(spark)}/test-warc"
    listed = warc.write(df, directory, archive_bytes=2000)
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    got = warc.read(spark, directory, content=True, listed=listed).collect()
    want = Counter()
    for page, _, html in pages:
        b = (html or "").encode()
        ids = [p for p, _, h in pages if (h or "").encode() == b]
        low = min((i for i in ids if i is not None), default=None)
        kind = "response" if page == low or low is None else "revisit"
        want[page, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), kind, None if kind == "response" else low] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == {(h or "").encode() for _, _, h in pages}
    small = warc.write(df, f"{directory}-2", min_payload=5).collect()
    again = warc.read(spark, f"{directory}-2").collect()
    assert sum(r["n_records"] for r in small) == len(pages) and all(r["record_type"] == "response" for r in again)
    assert warc.write(df.limit(0), f"{directory}-3").count() == 0
