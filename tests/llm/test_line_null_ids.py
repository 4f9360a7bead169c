"""Line runs in documents without ids."""

from densitykit.llm.line_dedup import dedup_lines
from tests.llm.edge import edge_docs, prose, rows
from tests.llm.test_near_dup_lines import brute_lines


def key(r):
    return (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")


def same_as_brute(docs, got, min_words):
    want = brute_lines(docs, min_words)
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((d, want[d, t]) for d, t in docs), key=key)


def test_edge_rows_with_null_ids(spark):
    got = dedup_lines(edge_docs(spark), min_words=50).collect()
    same_as_brute([(r[0], r[1]) for r in rows()], got, 50)
    gone = {r.doc_id: r.n_deleted for r in got}
    assert gone[1] == gone[3] == 1  # the copy without an id comes first


def test_runs_shared_by_documents_without_ids(spark):
    """One passage in two documents without an id and in one with an id; levels above 0 too."""
    run = "\n".join(prose(4, 40 + i) for i in range(20))
    docs = [(None, run + "\n" + prose(9, 1)), (5, prose(9, 2) + "\n" + run), (None, None), (None, ""), (6, prose(70, 3)), (None, prose(70, 4))]
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=50).collect()
    same_as_brute(docs, got, 50)
    assert {r.doc_id: r.n_deleted for r in got if r.doc_id} == {5: 20, 6: 0}
    both = [(None, run + "\nend one"), (None, "start two\n" + run)]
    got = dedup_lines(spark.createDataFrame(both, "doc_id long, text string"), min_words=50).collect()
    assert sorted(r.n_deleted for r in got) == [0, 20]
