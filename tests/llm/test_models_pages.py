import hashlib

import numpy as np
from pyspark.sql import functions as F

from densitykit.llm import decontaminate, fingerprints, langid, page_text, toxicity
from tests.conftest import SF
from tests.llm.edge import edge_docs, empty_docs, prose, rows
from tests.llm.test_substitutions import plain

ID_TEXT = "doc_id long, text string"


# ---- language ID

def test_gru_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = langid.BiGRU.new(["a", "b", "c"], hidden=3)
    net.par = {k: v.astype(np.float64) for k, v in net.par.items()}
    x = rng.integers(0, 256, (4, 5))
    mask = (np.arange(5)[None, :] < np.array([5, 3, 1, 4])[:, None]).astype(float)
    target, weight = rng.dirichlet(np.ones(3), 4), np.array([1.0, 0.5, 2.0, 1.0])
    _, g = net.gradients(x, mask, target, weight)
    for k, w in net.par.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)] + ([(int(x[0, 0]), 1)] if k[0] == "E" else []):
            old = w[at]
            w[at] = old + 1e-5
            up, _ = net.gradients(x, mask, target, weight)
            w[at] = old - 1e-5
            down, _ = net.gradients(x, mask, target, weight)
            w[at] = old
            assert abs((up - down) / 2e-5 - g[k][at]) < 1e-5, (k, at)


def test_language_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{SF['0.01']}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    net = langid.fit(docs.where(~held), steps=400)
    got = langid.predict(docs.where(held).select("doc_id", "lang", "text"), net).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    edge = langid.predict(edge_docs(spark).select("doc_id", "n_chars", "score", "text"), net, keep_text=True)
    assert edge.columns == ["doc_id", "n_chars", "text", "lang_pred", "score"]
    e = edge.collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in e) == sorted((-1 if r[0] is None else r[0], r[1] or "") for r in rows())
    for r in e:
        letters = any(ch.isalpha() for ch in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert langid.predict(empty_docs(spark), net).count() == 0
    none = langid.fit(empty_docs(spark))
    assert {r.lang_pred for r in langid.predict(edge_docs(spark), none).collect()} == {"und"}


def test_word_sums_do_not_depend_on_batch_or_place():
    net = langid.BiGRU.new(["a", "b"])
    text = "ab cdé ab " + "x" * 60 + " cdé"
    one = np.frombuffer(text.encode(), np.uint8)
    total, n = langid.WordLabels(net).rows(one, np.array([0, len(one)]))
    parts = [np.frombuffer(w.encode(), np.uint8) for w in text.split()]
    each = [langid.WordLabels(net).rows(p, np.array([0, len(p)])) for p in parts]
    assert np.allclose(total, sum(t for t, _ in each), atol=1e-4) and n[0] == sum(k[0] for _, k in each) == 3 + 60 + 4 + 4 + 1


# ---- decontamination

def test_decontamination_against_all_diagonals(spark):
    rng = np.random.default_rng(6)
    items = [(i, prose(n, 100 + i)) for i, n in enumerate([40, 25, 13, 9, 6, 5, 4, 0])] + [(50, None), (51, prose(40, 100)), (None, prose(40, 7))]
    docs = [(None, prose(50, 1) + " " + items[0][1]), (1, None), (2, ""), (3, prose(300, 2))]
    for i in range(40):
        k = i % 6
        w = items[k][1].split()
        if i >= 12:  # substitutions
            for p in rng.choice(len(w), max(1, len(w) // 10), replace=False):
                w[p] = f"sub{i}"
        if i >= 30:
            w.insert(len(w) // 2, "inserted")
        cut = " ".join(w[:20] if i % 5 == 0 else w).upper().replace(" ", ", ")
        docs.append((10 + i, f"{prose(30, 200 + i)}. {cut}! {prose(30, 300 + i)}"))
    docs.append((10, docs[4][1]))  # repeated row
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], ID_TEXT + ", item_id long, similarity long")
    b = spark.createDataFrame(items, "item_id long, text string")
    hs = {}

    def words_of(t):
        if t not in hs:
            raw = np.frombuffer((t or "").encode(), np.uint8)
            hs[t] = decontaminate.word_hashes(raw, np.array([0, len(raw)]))[0].tolist()
        return hs[t]

    def holds(t, u):
        return bool(words_of(u)) and plain(words_of(t), words_of(u))

    order = lambda rows: sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])
    want = order((i, j) for i, t in docs for j, u in items if holds(t, u))
    assert any(j is None for _, j in want) is any(holds(t, items[-1][1]) for _, t in docs)
    sizes = {j: len(words_of(u)) for j, u in items}
    found = decontaminate.contaminated(d, b)
    for blocks in (found, decontaminate.contaminated(d, b, block_words=30)):
        got = blocks.collect()
        assert order((r.doc_id, r.item_id) for r in got) == want
        assert all(r.n_overlap >= min(13, sizes[r.item_id]) and r.n_match >= 0.8 * r.n_overlap and r.item_words == sizes[r.item_id] for r in got)
    bad = {(i, t) for i, t in docs if any(holds(t, u) for _, u in items)}
    left = decontaminate.drop_contaminated(d, b, block_words=60)
    assert left.columns == d.columns
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in left.collect()) == sorted(-1 if i is None else i for i, t in docs if (i, t) not in bad)
    assert decontaminate.contaminated(empty_docs(spark), b).count() == 0
    assert decontaminate.contaminated(d, b.where("false")).count() == 0
    assert decontaminate.contaminated(edge_docs(spark), b).count() == 0


# ---- toxicity

def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    n, k = 300, 8
    x = (rng.random((n, k)) < 0.3) * 1.0
    f = x @ np.array([3.0, 2, 0, 0, 0, 0, 0, -2])
    y = np.clip((f + rng.normal(0, 0.5, n) > 1).astype(int) + (f > 2.5) + (f > 4.5), 0, 3)
    r, c = np.nonzero(x)
    w, theta, losses = toxicity.fit_ordinal(r, c, x[r, c], y, k, 4, 0.0, 0.1, 400)
    assert losses[-1] < 0.6 * losses[0] and (np.diff(theta) > 0).all() and w[0] > 1 and w[1] > 1 and w[7] < 0
    th, s = np.array([0.0, 1.0, 2.0]), rng.normal(0, 1, n)
    df, g, _ = toxicity._loss_parts(th, s, y)
    for j in range(3):
        e = np.eye(3)[j] * 1e-6
        assert abs((toxicity._loss_parts(th + e, s, y)[2] - toxicity._loss_parts(th - e, s, y)[2]) / 2e-6 - g[j]) < 1e-3
    e = np.zeros(n)
    e[5] = 1e-6
    assert abs((toxicity._loss_parts(th, s + e, y)[2] - toxicity._loss_parts(th, s - e, y)[2]) / 2e-6 - df[5]) < 1e-4


def test_toxicity_on_unseen_labels_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learn = F.xxhash64("doc_id", F.lit(5)) % 2 == 0
    model = toxicity.fit(docs, labels.where(learn))
    got = toxicity.predict(docs, model).withColumnRenamed("toxic", "found").join(labels.where(~learn).select("doc_id", "toxic"), "doc_id").collect()
    clean = [r.found for r in got if r.toxic == 0]
    bad = [r.found for r in got if r.toxic == 1]
    assert np.mean(clean) < 0.01 and np.mean(bad) > 0.9
    assert np.mean([r.severity for r in got if r.toxic == 1]) > 20 * np.mean([r.severity for r in got if r.toxic == 0])
    e = toxicity.predict(edge_docs(spark), model).collect()
    assert len(e) == len(rows()) and all(0 <= r.severity <= 3 and r.grade in range(4) for r in e)
    assert len({r.severity for r in e if r.doc_id in (4, 5, 6)}) == 1
    one = spark.createDataFrame([(1, "idiot moron scum trash idiot"), (2, "the is of")], ID_TEXT)
    s = {r.doc_id: r for r in toxicity.predict(one, model).collect()}
    assert s[1].toxic and not s[2].toxic and s[1].severity > s[2].severity
    none = toxicity.fit(empty_docs(spark), labels)
    assert not any(r.toxic for r in toxicity.predict(edge_docs(spark), none).collect())
    assert toxicity.predict(empty_docs(spark), model).count() == 0


# ---- fingerprints

def sketch_of(*texts):
    raw = [t.encode("utf-32-le") for t in texts]
    return fingerprints.sketches(np.frombuffer(b"".join(raw), np.uint32), np.cumsum([0, *(len(r) // 4 for r in raw)]))


def test_parse_is_locally_consistent():
    rng = np.random.default_rng(8)
    core = "".join(rng.choice(list("abcdefgh "), 3000))
    left, right = "".join(rng.choice(list("xyz"), 137)), "".join(rng.choice(list("uvw"), 55))
    x = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (core, left + core + right)]
    cuts = []
    for p in x:
        h = fingerprints.mix(p.astype(np.uint64))
        cuts.append(np.flatnonzero(fingerprints._starts(h, np.array([0]))))
    inner = cuts[1] - len(left)
    assert set(cuts[0][(cuts[0] > 10) & (cuts[0] < 2990)]) == set(inner[(inner > 10) & (inner < 2990)])
    gaps = np.diff(cuts[0])
    assert gaps.min() >= 2 and gaps.max() <= 16
    a, b = sketch_of(core, left + core + right)
    assert fingerprints.likeness(a, b) > 0.85


def test_sketches_stand_alone_and_short_texts():
    texts = ["", "a", "ab", "aaaa" * 500, "abc abc abc", prose(300, 3), "", prose(300, 3), "\U0001f600é" * 40]
    together = sketch_of(*texts)
    for t, s in zip(texts, together):
        assert (s == sketch_of(t)[0]).all() and len(s) <= fingerprints.SIZE and (len(s) > 0) == bool(t)
    assert fingerprints.likeness(together[5], together[7]) == 1 and fingerprints.likeness(together[0], together[6]) == 1
    assert fingerprints.likeness(together[0], together[1]) == 0


def test_edited_fingerprints(spark):
    docs = edge_docs(spark)
    got = fingerprints.edited_fingerprints(docs).collect()
    order = [(r.doc_id, r.text or "", r.h) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    want = []
    for i, (d, t, _) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        k = len(t) // 2
        e = t[:len(t) - k] + nxt[:k]
        a, b, c = sketch_of(t, e, nxt)
        want.append((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprints.text_of(a), fingerprints.text_of(b),
                     fingerprints.likeness(a, b), fingerprints.likeness(a, c)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got) == sorted(want)
    plain = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(docs).collect()}
    assert plain == {(r.doc_id, r.fingerprint) for r in got}
    assert fingerprints.edited_fingerprints(empty_docs(spark)).count() == 0
    one = fingerprints.edited_fingerprints(docs.where("doc_id = 15")).collect()
    assert len(one) == 1 and one[0].near_next == 1


# ---- page text

PAGE = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/x'>one</a></li></ul></nav>"
        "<div class=\"cookie-notice\"><p>We use cookies on this site and some more words.</p></div><article><header><h1>Head &amp; tail</h1></header>"
        "<p>Hello  <b>wor</b>ld, this\nis&nbsp;it.</p><aside>Related things</aside><div class='ad'>Buy now</div><ul><li>first</li><li>second</li></ul>"
        "<!-- hidden > --><p>a &lt; b<form>mail <input></form><section id=\"comments\"><p>Nice post I liked it</p></section></article><footer>&copy; x</footer></body></html>")


def test_page_text_by_hand():
    w = page_text.Weights()
    assert page_text.extract(PAGE, w) == "Head & tail Hello world, this is it. first second a < b"
    for broken, want in (("plain < text &amp; more", "plain < text & more"), ("<p>a <!-- x", "a"), ("<script>x", ""), ("<p class=\"a>b</p>c", "b c"),
                         ("", ""), ("<nav>a b</nav>", ""), ("<p>x</p><p> </p>\n<p>y\tz</p>", "x y z")):
        assert page_text.extract(broken, w) == want, broken


def test_scan_finds_the_greatest_sum():
    rng = np.random.default_rng(3)
    w = page_text.Weights(tag={"i1": -3.0, "i2": -1.0})
    for _ in range(60):
        parts = [rng.choice(["<i1>", "<i2>", "w", "w w w w"]) for _ in range(14)]
        page = " ".join(f"{p}" for p in parts)
        score = {"<i1>": -3, "<i2>": -1, "w": 1, "w w w w": 4}
        best = max(sum(score[p] for p in parts[a:b]) for a in range(14) for b in range(a, 15))
        got = page_text.extract(page, w).split()
        keep = [sum(score[p] for p in parts[a:b]) == best and [x for p in parts[a:b] if p[0] == "w" for x in p.split()] == got
                for a in range(14) for b in range(a, 15)]
        assert any(keep)


def test_pages_against_the_articles(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF['0.01']}/pages.parquet")
    got = {r.page_id: r for r in page_text.page_text(pages, page_text.fit(pages)).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|br|h1)>", "\n", body))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_page_edges(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    df = spark.createDataFrame([(1, None, None, "t", "c"), (2, "u", "", "t", None), (None, "v", PAGE, None, None), (3, "w", PAGE, None, None), (3, "w", PAGE, None, None),
                                (4, "x", "<p>" + "word " * 100_000, None, None)], schema)
    w = page_text.fit(df)
    got = page_text.page_text(df, w)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    n = sorted((-1 if r.page_id is None else r.page_id, r.n_chars) for r in got.collect())
    assert [k for k, _ in n] == [-1, 1, 2, 3, 3, 4] and [c for _, c in n][1:3] == [0, 0] and n[-1][1] == 499_999
    none = spark.createDataFrame([], schema)
    assert page_text.page_text(none, page_text.fit(none)).count() == 0
