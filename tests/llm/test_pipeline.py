import re

import corpus_pipeline
from millrace.llm import common, quality

from .test_jaccard import brute as jaccard_brute
from .test_packing import check as check_packing
from .test_pii import brute as pii_brute


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept[-1], sf)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]
    scores = quality.score(docs, quality.fit(docs, common.table(spark, sf, "labels"))).collect()
    assert set(rows[1]) == {r.doc_id for r in scores if r.score >= 0.3} and 0 < len(rows[1]) < len(rows[0])
    largest = {}
    for i, r in rows[1].items():
        largest[r.text] = max(i, largest.get(r.text, -1))
    assert set(rows[2]) == set(largest.values()) and len(rows[2]) < len(rows[1])
    parts = jaccard_brute([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, _, c in parts if i == c}
    for i, r in rows[3].items():
        assert rows[2][i] == r
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in pii_brute(r.text)))
        text, at = "", 0
        for s, e, k in spans:
            if s >= at:
                text += r.text[at:s] + f"[{k.upper()}]"
            at = max(at, e)
        text += r.text[at:]
        assert rows[4][i].text == text and rows[4][i].n_chars == len(text)
        assert rows[4][i].source == r.source
    assert set(rows[4]) == set(rows[3]) and any(re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text) for r in rows[4].values())
    assert check_packing(kept[-1].collect(), {i: r.text for i, r in rows[4].items()}) < 0.02


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, repeats, ties, a very long text and columns named as the operators name theirs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = docs.where("length(text) > 300").orderBy("doc_id").first().text
    rows = [(1, good, 1, None), (1, good, 2, "x"), (None, good, 3, None), (7, None, 4, None), (8, "", 5, None), (None, None, 6, None), (9, good + " and some more", 7, ""), (10, (good + " ") * 300 + "end", 8, None)]
    names = "doc_id long, text string, score int, _uid string"
    for table in (spark.createDataFrame(rows, names), spark.createDataFrame([], names)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[1:]:
            path = str(tmp_path / f"{name}-{table.isEmpty()}")
            if name == "near_dedup":
                kept = kept.withColumnRenamed("_uid", "node")
            stage(spark, kept, "/root/testdata/sf0.001").write.parquet(path)
            kept = spark.read.parquet(path)
            if name == "exact_dedup" and not table.isEmpty():
                left = kept.collect()
                assert sorted(((r.text or "")[:5], r.doc_id) for r in left if r.doc_id not in (9, 10)) == [("", 8), (good[:5], 1)]
            if name == "near_dedup" and not table.isEmpty():
                assert {r.doc_id for r in kept.collect()} in ({1, 8}, {1, 8, 10}, {1, 8, 9}, {1, 8, 9, 10})
        if table.isEmpty():
            assert kept.count() == 0
    scored = quality.keep_good(spark.createDataFrame(rows, names), quality.fit(docs, common.table(spark, "/root/testdata/sf0.001", "labels")))
    assert scored.columns == ["doc_id", "text", "score", "_uid"]


def test_one_row_of_each_group_stays(spark):
    from millrace.llm import jaccard

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (5, text + " x", 2), (3, text, 3), (3, text, 4), (None, "other words here", 5), (None, "other words here", 6), (None, None, 7)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, k int").coalesce(1)).collect()
    assert sorted(r.k for r in kept) == [3, 5, 7]
