"""Every stage on null and repeated ids, null and empty texts, repeated rows, clashing columns and an empty table."""

from collections import Counter

import corpus_pipeline
from kvjoin.llm.common import materialize

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


def test_stages_with_odd_rows(spark, edge, nothing):
    for start in (edge, nothing):
        docs = materialize(start)
        for name, stage in corpus_pipeline.STAGES:
            out = materialize(stage(spark, docs, SF))
            before, after = rows(docs), rows(out)
            if name in ("language_id", "near_dedup", "decontaminate"):
                assert not after - before, name
            if name == "language_id":
                assert all(any(c.isalpha() for c in r["text"]) for r in out.select("text").collect())
            if name == "line_dedup":
                assert Counter(r["doc_id"] for r in docs.collect()) >= Counter(r["doc_id"] for r in out.collect())
            if name == "near_dedup":
                texts = Counter(r["text"] for r in out.collect())
                assert max(texts.values(), default=1) == 1 and all(r[1] for r in after)
            if name != "mix":
                assert out.columns == start.columns, name
            else:
                assert {r[:2] for r in after} <= {r[:2] for r in before}
                assert all(r["copy_no"] <= r["n_copies"] for r in out.collect())
            docs = out
        if start is nothing:
            assert docs.count() == 0
        else:
            assert docs.count() > 0 and set(start.columns) <= set(docs.columns)
