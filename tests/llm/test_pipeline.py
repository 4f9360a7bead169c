"""The pipeline's stages, each against a brute-force form on its own input."""

import numpy as np
import pytest

import __spark_entry__ as E
import corpus_pipeline
from densitykit.llm.queries import tokenizer_file
from tests.conftest import SF
from tests.llm.edge import prose
from tests.llm.test_near_dup_lines import brute, brute_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(corpus_pipeline.STAGES)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts],
                                 "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF['0.001']}/documents.parquet")


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "benchmark", "packing"]
    assert "pipeline" in E.queries() and {f"op{i}" for i in range(1, 14)} == {q.split("_")[0] for q in E.queries() if q.startswith("op") and q[2].isdigit()}


def test_language_stage(spark, corpus):
    extra = docs_of(spark, [(9001, None), (9002, ""), (9003, "123 !!! 456"), (9004, "the of and the to in that")])
    out = STAGES["language"](spark, corpus.unionByName(extra), SF["0.001"])
    assert out.columns == COLUMNS
    kept = {r.doc_id: tuple(r) for r in out.collect()}
    assert not {9001, 9002, 9003} & set(kept) and 9004 in kept
    before = {r.doc_id: tuple(r) for r in corpus.collect()}
    assert all(kept[i] == before[i] for i in kept if i in before)
    assert len(kept) >= 0.99 * len(before)


def test_lines_stage(spark, corpus):
    out = STAGES["lines"](spark, corpus, SF["0.001"])
    assert out.columns == COLUMNS
    want = brute_lines([(r.doc_id, r.text) for r in corpus.collect()], 50)
    want = {d: t for (d, old), t in want.items() if t == old or (t and t.strip())}
    got = {r.doc_id: r for r in out.collect()}
    assert {d: r.text for d, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_near_duplicate_stage(spark, corpus):
    a = prose(80, 1)
    extra = docs_of(spark, [(8001, a), (8001, a), (8002, a + " more"), (8003, prose(80, 2)), (8003, a), (8004, None), (8005, ""), (8006, None), (None, a), (None, prose(30, 9))])
    both = corpus.unionByName(extra)
    out = STAGES["near_duplicates"](spark, both, SF["0.001"])
    assert out.columns == COLUMNS
    rows = list({(r.doc_id, r.text) for r in both.collect()})
    want = sorted((-1 if d is None else d, t or "") for (d, t), (_, _, c) in zip(rows, brute(rows, 5)) if d == c or not (t or "").split())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in out.collect()) == want


def test_benchmark_stage(spark, corpus):
    items = [r.text for r in spark.read.parquet(f"{SF['0.001']}/benchmark.parquet").collect()]
    extra = docs_of(spark, [(7001, prose(40, 5) + " " + items[0] + " " + prose(40, 6)), (7002, items[3].upper()), (7003, prose(300, 7)), (7004, None), (None, items[1])])
    out = STAGES["benchmark"](spark, corpus.unionByName(extra), SF["0.001"])
    assert out.columns == COLUMNS
    left = {r.doc_id for r in out.collect()}
    assert not {7001, 7002, None} & left and {7003, 7004} <= left
    flat = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "")).lower().split())
    whole = {r.doc_id for r in corpus.collect() if any(flat(i) in flat(r.text) for i in items)}
    assert whole.isdisjoint(left) and len(left) >= corpus.count() - len(whole) - 2


def test_packing_stage_and_empty_input(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    out = STAGES["packing"](spark, corpus, SF["0.001"]).collect()
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in corpus.collect()}
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    fill = sum(want.values()) / 2048 / (1 + max(r.sequence_id for r in out))
    assert fill > 0.9 and np.isfinite(fill)
    none = docs_of(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF["0.001"]).count() == 0, name


def test_run_from_end_to_end(spark, corpus):
    """All five stages, written and read between them, against brute force for lines, copies and token counts."""
    from tokenizers import Tokenizer

    out = corpus_pipeline.run(spark, SF["0.001"]).collect()
    named = STAGES["language"](spark, corpus, SF["0.001"])
    cut = brute_lines([(r.doc_id, r.text) for r in named.collect()], 50)
    cut = [(d, t) for (d, old), t in cut.items() if t == old or (t and t.strip())]
    one = [(d, t) for (d, t), (_, n, c) in zip(cut, brute(cut, 5)) if d == c or not n]
    items = [r.text for r in spark.read.parquet(f"{SF['0.001']}/benchmark.parquet").collect()]
    flat = lambda t: " ".join("".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "")).lower().split())
    hit = {d for d, t in one if any(flat(i) in flat(t) for i in items)}
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in one if d not in hit}
    got, fill = {}, {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert r.doc_tokens == want.get(r.doc_id, r.doc_tokens)
    assert hit.isdisjoint(got) and set(got) <= set(want) and len(got) >= len(want) - 3  # a few hold a passage, not a whole item
    assert all(got[d] == want[d] for d in got) and max(fill.values()) <= 2048
