"""Queries over all rows, on rows with gaps and other languages."""

from quarry.catalogue import queries
from tests.conftest import SF


def test_first_sources_of_a_topic_with_gaps(spark, tmp_path):
    docs = [(k, f"title {k} grounded words here", None if k % 3 else "de", "src1") for k in range(0, 180, 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    blocks = {r.topic_id: r.block.split("\n") for r in queries()["evidence_block"](spark, str(tmp_path)).collect()}
    assert [len(blocks[0]), len(blocks[1])] == [5, 4] and blocks[1][0].startswith("[0] title 100 ")
    grounded = {r.doc_id: r.grounded for r in queries()["quote_grounding_all"](spark, str(tmp_path)).collect()}
    assert len(grounded) == 9 and all(grounded.values())
    assert queries()["label_spans_all"](spark, str(tmp_path)).select("doc_id").distinct().count() == 9
    claims = queries()["claim_source_pairs_all"](spark, str(tmp_path)).select("topic_id", "claim_index").distinct().count()
    assert claims == 9  # ev_id % 5 is 0 throughout, and every topic has a source 0


def test_no_row_is_left_out(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries()["quote_grounding_all"](spark, SF).count() == n


def test_discovery_has_three_rounds_and_counts_the_wide_list(spark):
    rows = queries()["feedback_rounds"](spark, SF).collect()
    assert {r["round"] for r in rows} == {1, 2, 3}
    assert max(r.n_new for r in rows if r["round"] == 1) > 8


def test_discovery_writes_no_texts(spark, monkeypatch):
    """All texts were written once more beside the index, in row groups that a task holds until they are full."""
    from quarry.plans import evaluation as E

    written, keep = [], E.materialise
    monkeypatch.setattr(E, "materialise", lambda df, name="stage", **kw: (written.extend(df.columns), keep(df, name, **kw))[1])
    assert E.feedback_rounds(spark, SF).count() and written and "doc_text" not in written


def test_whole_index_finds_what_stands_behind_the_window(spark, tmp_path):
    docs = [(k, "word " * 400 + ("zymurgy" if k == 3 else "other"), "en", "src1") for k in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "zymurgy")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [(r.topic_id, r.id, r.score) for r in queries()["bm25_index_whole"](spark, str(tmp_path)).collect()] == [(0, 3, 1.0)]
    assert queries()["bm25_index"](spark, str(tmp_path)).count() == 0
