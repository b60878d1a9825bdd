import corpus_pipeline as pipeline
from quarry.storage import materialise
from tests.conftest import SF


def test_stages_work_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) >= 0.8 * len(ids)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and [f.dataType for f in docs.schema] == [f.dataType for f in before.select(*docs.columns).schema]
        ids = left
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_planted_cases_go_and_clean_documents_stay(spark):
    import random

    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    item, passage = prose(40), prose(60)
    first = prose(200)
    texts = [first, first, first + " more", prose(300), prose(100) + " " + passage + " " + prose(90), prose(80) + " " + passage + " " + prose(110), prose(90) + " " + item + " " + prose(100), None, "", "77 88"]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    from quarry.llm.decontaminate import containment_matches

    kept = {r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == set(range(10)) - {1, 2}
    cut = {r.doc_id: r for r in pipeline.suffix_dedup(spark, docs.filter("doc_id not in (1, 2)"), SF).collect()}
    assert passage[8:-8] not in cut[4].text and passage[8:-8] not in cut[5].text and cut[3].text == texts[3] and cut[4].n_chars == len(cut[4].text)
    assert [r.doc_id for r in containment_matches(docs, bench).collect()] == [6]
    kept = {r.doc_id for r in pipeline.language_id(spark, docs, SF).collect()}
    assert 7 not in kept and 8 not in kept and 9 not in kept


def test_the_whole_pipeline_equals_a_plain_restatement(spark):
    """Every stage by brute force over all that the one before kept, on plain Python lists."""
    import re

    import public_tokenizers as P
    import tiktoken

    from quarry.llm.bpe import read_ranks
    from tests.llm.test_operators import brute_components, brute_removal, plain_dictionaries, plain_language

    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    known = plain_dictionaries(rows)
    left = {}
    for r in rows:
        lang, margin = plain_language(r.text, known)
        if lang != "und" and margin >= 0.001:
            left[r.doc_id] = r.text
    ids = sorted(left)
    group, sizes = brute_components([left[k] for k in ids], 5, 80)
    ids = [k for at, k in enumerate(ids) if group[at] == at or not sizes[at]]
    texts = {}
    for k, (n_removed, _, kept) in zip(ids, brute_removal([left[k].encode() for k in ids], pipeline.REPEAT_BYTES), strict=True):
        text = kept.decode(errors="replace").replace("\ufffd", "") if n_removed else left[k]
        if not n_removed or text.strip(" "):
            texts[k] = text
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [runs(split(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert all(items)  # every item has five words or more
    texts = {k: t for k, t in texts.items() if not any(100 * len(i & runs(split(t))) >= 80 * len(i) for i in items)}
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        assert list(got[k].ids) == lib.encode_ordinary(t) and got[k].n_tokens == len(got[k].ids)


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, clashing columns and empty tables in every stage."""
    long = " ".join(f"word{k}" for k in range(120))
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (None, "the plain words of a line", "en", "s", 25), (4, "der die und das", "de", "s", 15)]
    docs = spark.createDataFrame([(*r, True, "x", [1]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string, ids array<int>")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    assert ids(pipeline.near_dedup(spark, docs, SF)) == [1, 2, 3, 3, 4, None]
    cut = pipeline.suffix_dedup(spark, docs, SF)
    assert ids(cut) == [1, 2, 4, None] and {r.doc_id: r.text for r in cut.collect()}[1] is None
    assert ids(pipeline.decontaminate(spark, docs, SF)) == [1, 2, 3, 3, 4, None]
    assert ids(pipeline.encode(spark, docs, SF)) == [1, 2, 3, 3, 4, None]
    assert set(ids(pipeline.language_id(spark, docs, SF))) <= {3, 4, None}
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_rows_without_an_id_are_held_to_the_same_rules(spark, tmp_path):
    item = " ".join(f"b{k}" for k in range(60))
    clean = [" ".join(f"{c}{k}" for k in range(80)) for c in "pqr"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, clean[0], "en", "s", 1), (4, clean[0], "en", "s", 1), (None, clean[1], "en", "s", 1), (None, clean[1], "en", "s", 1), (None, f"x y z {item}", "en", "s", 1), (9, clean[2], "en", "s", 1), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted(((r.doc_id, (r.text or "")[:1]) for r in kept.collect()), key=repr) == sorted([(4, "p"), (None, "q"), (None, "x"), (9, "r"), (None, "")], key=repr)
    left = pipeline.decontaminate(spark, kept, str(tmp_path)).collect()
    assert sorted((r.text or "")[:1] for r in left) == ["", "p", "q", "r"] and set(left[0].asDict()) == set(pipeline.COLUMNS)
