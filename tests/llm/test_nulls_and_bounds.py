"""Null ids, short and unspaced items, and the bounds of the samples that models are fitted on."""

import numpy as np

from densitykit.llm import decontaminate, langid, page_text, toxicity
from densitykit.llm.common import bounded_sample
from densitykit.llm.near_dup import near_duplicates
from tests.llm.edge import prose


def changed(text, places):
    w = text.split()
    for p in places:
        w[p] = f"other{p}"
    return " ".join(w)


def test_documents_without_id_link(spark):
    a = prose(150, 21)
    bridge, far = changed(a, (10, 20)), changed(a, (10, 20, 60, 80))
    alone = prose(120, 22)
    rows = [(1, a), (None, bridge), (3, far), (None, alone), (None, changed(alone, (5,))), (None, alone), (9, prose(100, 23))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df, width=4).collect()
    by = {(r.doc_id, r.text_hash): r for r in got}
    assert len(got) == 7 and {r.component_id for r in got if r.doc_id in (1, 3)} == {1}
    assert sorted((r.component_id or 0) for r in got if r.doc_id is None) == [0, 0, 0, 1]
    lone = [r for r in got if r.doc_id is None and r.component_id is None]
    assert len({r.text_hash for r in lone}) == 2 and len({r.text_hash for r in lone if r.kept}) == 1
    assert [r.kept for r in got if r.component_id == 1 and r.doc_id is None] == [False] and len(by) == 6


def test_short_unspaced_and_unnamed_items(spark):
    items = [(1, "one two three four"), (2, "quartz vixen"), (None, prose(30, 41)), (4, "これはとても長い一つの文章です"), (5, "ภาษาไทยไม่มีช่องว่าง"), (6, ""), (7, None)]
    docs = [(1, "so: one, two three FOUR."), (2, "one two three five"), (3, "a quartz vixen"), (4, "quartz, no vixen"), (5, prose(9, 1) + " " + items[2][1]),
            (6, "前置き。これはとても長い一つの文章です。後"), (7, "これはとても短い一つの文章です"), (8, "กขค" + items[4][1] + "งจ"), (9, "まったく別の話をここに書いておきます")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1), (3, 2), (5, None), (6, 4), (7, 4), (8, 5)}  # 7 has 13 of 15 characters
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {2, 4, 9}
    assert {r.doc_id for r in decontaminate.contaminated(d, b, min_words=5).collect()} == {5, 6, 7, 8}


def test_bounded_sample(spark):
    df = spark.range(4000).selectExpr("if(id < 2500, 7, if(id < 2600, null, id)) k", "concat('t', id % 3000) t", "id v")
    for n in (1, 50, 10_000):
        got = bounded_sample(df, "k", "t", n).collect()
        pairs = {(r.k, r.t) for r in got}
        assert len(got) == len(pairs) == min(n, df.select("k", "t").distinct().count())
    assert {(r.k, r.t, r.v) for r in got} == {(r.k, r.t, r.v) for r in df.groupBy("k", "t").agg({"v": "min"}).withColumnRenamed("min(v)", "v").collect()}


def test_sample_rows_hold_on_one_id(spark, monkeypatch):
    texts = [prose(20, i) for i in range(300)]
    df = spark.createDataFrame([(5, t, "en" if i % 2 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "train", lambda x, n, target, weight, langs, steps: seen.setdefault("words", len(x)))
    langid.fit(df, sample_rows=1)
    assert 0 < seen["words"] <= 20
    y, first, _, _ = toxicity.labelled_features(df, spark.createDataFrame([(5, 1)], "doc_id long, toxic int"), 10, "doc_id", "text", "toxic")
    assert len(y) == 1 and np.diff(first)[0] <= 60
    pages = spark.createDataFrame([(None, f"<html><article><p>a{i} word</p></article><div>menu</div></html>") for i in range(50)], "page_id long, html string")
    assert page_text.fit(pages, sample_rows=1).word and page_text.fit(pages, sample_rows=50).word


def test_labels_without_ids_are_learned(spark):
    rows = [(None, "the house and the garden of the man", "en"), (None, "das haus und der garten von dem mann", "de")] * 3
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), steps=60)
    assert net.langs == ["de", "en"]
