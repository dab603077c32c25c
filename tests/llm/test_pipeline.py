"""The pipeline's stages against brute force, each on its own input, and run() against their composition."""

from collections import Counter

import pytest
from test_dedup import brute_classes
from test_native import brute_hits, brute_lines, brute_mix

import corpus_pipeline
from kvjoin.llm import language
from kvjoin.llm.common import texts


@pytest.fixture(scope="module")
def sf(spark, edge, edge_rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    # a row more for each of the doubtful ids, so that ties of ids don't matter for line dedup
    edge.where("doc_id IS NOT NULL AND words = 'clash'").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, edge_rows[18][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_stages(spark, sf, edge_rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, lang), (_, lines), (_, near), (_, clean), (_, mix) = corpus_pipeline.STAGES
    a = lang(spark, docs, sf).cache()
    model = language.fit(*language.sample(docs))
    want = [r["doc_id"] for r in language.predict(texts(docs), model).collect() if r["lang_pred"] != "und" and r["score"] >= language.MIN_SCORE]
    assert ids(a) == Counter(want) and a.columns == docs.columns and len(want) > 10

    b = lines(spark, a, sf).cache()
    got = {(r["doc_id"], r["text"]) for r in b.collect()}
    told = brute_lines([(r["doc_id"], r["text"]) for r in a.collect()])
    emptied = {int(r[0]) for r in told if r[1] == r[2] != "0"}
    assert ids(b) == Counter({k: v for k, v in ids(a).items() if k not in emptied}) and b.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in b.collect()) and 10 not in {g[0] for g in got}

    c = near(spark, b, sf).cache()
    classes = {k[1] for k in brute_classes([(r["doc_id"], r["text"]) for r in b.collect()])}
    assert ids(c) == Counter(dict.fromkeys(classes, 1)) and c.columns == docs.columns

    d = clean(spark, c, sf).cache()
    hits = brute_hits([(r["doc_id"], r["text"]) for r in c.collect()], [(1, edge_rows[18][1])])
    assert ids(d) == Counter(int(h[0]) for h in hits if h[2] == "0") and any(h[2] != "0" for h in hits) and d.columns == docs.columns

    e = mix(spark, d, sf)
    assert Counter((r["doc_id"], r["source"]) for r in e.collect()) == brute_mix([(r["doc_id"], r["source"]) for r in d.collect()], None)
    assert Counter(map(str, corpus_pipeline.run(spark, sf).collect())) == Counter(map(str, e.collect()))


def test_empty(spark, nothing, sf, tmp_path):
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
