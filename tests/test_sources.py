import json

from pyspark.sql import functions as F

from quarry.functions.text import redact
from quarry.plans.text_work import SECRET
from quarry.sources import dumps as D


def load(spark, tmp_path, name, schema, rows):
    path = tmp_path / f"{name}.jsonl"
    path.write_text("\n\n".join(json.dumps(r) for r in rows))
    return D.read_json_lines(spark, f"file://{path}", schema)


def test_europe_pmc_prefers_the_pmc_id(spark, tmp_path):
    rows = [
        {"pmid": "7", "pmcid": "PMC3", "doi": "10.1/x", "title": "A <i>title</i>", "abstractText": "<p>Text</p>  here", "citedByCount": 4, "pubTypeList": {"pubType": ["review"]}},
        {"doi": "10.1/y", "title": "B"}, {"title": "no url"},
    ]
    got = D.normalise_dump(load(spark, tmp_path, "e", D.EUROPE_PMC, rows), D.europe_pmc(), "europe_pmc").orderBy("title").collect()
    assert [(r.title, r.url, r.content, r.citation_count, r.publication_types) for r in got] == [("A title", "https://europepmc.org/article/PMC/PMC3", "Text here", 4, ["review"]), ("B", "https://doi.org/10.1/y", "", 0, [])]


def test_other_json_dumps(spark, tmp_path):
    trial = D.normalise_dump(load(spark, tmp_path, "t", D.TRIALS, [{"nctId": "NCT1", "briefTitle": "T", "overallStatus": "COMPLETED", "phases": ["PHASE3"], "enrollment": 1200, "conditions": list("abcdefg"), "summary": "s" * 5000}]), D.clinicaltrials(), "clinicaltrials").first()
    assert "Phase: PHASE3" in trial.content and "a, b, c, d, e\n" in trial.content and len(trial.content) == 4000 and len(trial.snippet) == 300
    label = D.normalise_dump(load(spark, tmp_path, "o", D.OPENFDA, [{"set_id": "1", "openfda": {"brand_name": ["Bee"]}, "warnings": ["w" * 900]}, {"set_id": "2", "openfda": {}}]), D.openfda(), "openfda").collect()
    assert [(r.title, r.content) for r in label] == [("Bee drug label", "Warnings: " + "w" * 800)]
    ema = D.normalise_dump(load(spark, tmp_path, "m", D.EMA, [{"name": "N", "url": "u", "orphan": "Yes", "generic": "no", "biosimilar": "yes", "prime": " YES", "last_updated": "05/03/2020"}, {"url": "u"}]), D.ema(), "ema").collect()
    assert [(r.content, r.publication_date) for r in ema] == [("Flags: orphan, PRIME priority medicine, biosimilar", "2020-03-05")]
    works = load(spark, tmp_path, "w", D.WORKS, [{"DOI": "10.1101/a", "title": ["P"], "posted": {"date-parts": [[2021, 3, 9]]}}, {"DOI": "10.2/b", "title": ["Q"], "institution": [{"name": "medRxiv"}]}, {"DOI": "10.2/c", "title": ["R"]}])
    got = D.normalise_dump(works.filter(D.is_preprint_work()), D.biorxiv(), "biorxiv").orderBy("title").collect()
    assert [(r.title, r.publication_date) for r in got] == [("P", "2021-03-09"), ("Q", "")]
    wiki = D.normalise_dump(load(spark, tmp_path, "k", D.EXTRACTS, [{"title": "A b", "extract": "x", "language": "it"}]), D.wikipedia(), "wikipedia").first()
    assert wiki.url == "https://it.wikipedia.org/wiki/A_b"


def test_pubmed_xml(spark, tmp_path):
    authors = "".join(f"<Author><LastName>L{k}</LastName><Initials>I</Initials></Author>" for k in range(8))
    (tmp_path / "p.xml").write_text(
        "<Set><PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>Title</ArticleTitle><Abstract><AbstractText Label='AIM'>One</AbstractText><AbstractText>Two</AbstractText></Abstract>"
        f"<AuthorList>{authors}</AuthorList><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article>"
        "<MeshHeadingList><MeshHeading><DescriptorName>Heart</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation></PubmedArticle></Set>"
    )
    dump = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(D.PUBMED).load(f"file://{tmp_path}/p.xml")
    r = D.normalise_dump(dump, D.pubmed(), "pubmed", 8000).first()
    assert (r.title, r.url, r.publication_date, r.publication_types) == ("Title", "https://pubmed.ncbi.nlm.nih.gov/12/", "2020-Mar", ["Review"])
    assert r.content.startswith("AIM: One\nTwo\nAuthors: L0 I, L1 I") and "et al." in r.content and r.content.endswith("MeSH: Heart")


def test_corpora_history_and_publication(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"id": "a", "type": "yesno"}, {"id": "b", "type": "list"}]}))
    assert {r.id for r in D.read_questions(spark, f"file://{tmp_path}/q.json", "id: string, type: string").collect()} == {"a", "b"}
    for folder, files in (("tok", {"1": "a b c", "2": "x y"}), ("lab", {"1": "0,1,1", "2": "0"})):
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / f"{name}.txt").write_text(text)
    got = D.read_aligned(spark, f"file://{tmp_path}/tok", f"file://{tmp_path}/lab").collect()
    assert sorted((r.doc, r.position, r.token, r.label) for r in got if r.error is None) == [("1", 0, "a", "0"), ("1", 1, "b", "1"), ("1", 2, "c", "1")]
    assert [r.doc for r in got if r.error] == ["2"]

    path = f"file://{tmp_path}/history"
    for ts, done in ((1, 2), (2, 5)):
        D.append_history(spark.createDataFrame([("e", ts, done, 5)], "eval string, ts long, n_done long, n_total long"), path)
    assert [(r.ts, r.complete) for r in D.latest_history(spark, path).collect()] == [(2, True)]
    D.publish(spark.createDataFrame([("x?api_key=abc&y",)], "t string"), f"file://{tmp_path}/out", ["t"], lambda c: redact(c, SECRET))
    assert [r.t for r in spark.read.json(f"file://{tmp_path}/out").collect()] == ["x?api_key=[redacted]&y"]
    rows = spark.range(5).select(F.col("id"))
    assert {r.id for r in D.pending(rows, rows.filter("id < 3")).collect()} == {3, 4}


def test_a_broken_run_goes_on(spark, tmp_path):
    def measure(text):
        if text == "bad":
            raise ValueError("no")
        return len(text)

    path = str(tmp_path / "run")
    first = spark.createDataFrame([(1, "abc"), (2, "bad"), (2, "bad"), (3, None)], "id long, input string")
    D.run_pending(first, path, measure)
    more = first.unionByName(spark.createDataFrame([(1, "changed"), (4, "x")], "id long, input string"))
    got = {r.id: (r.value, r.error) for r in D.run_pending(more, path, measure, parts=3).collect()}
    assert got[1] == (3.0, None) and got[2] == (None, "no") and got[4] == (1.0, None) and got[3][0] is None and got[3][1]
    assert spark.read.parquet(path).count() == 4
    empty = spark.createDataFrame([], "id long, input string")
    assert D.run_pending(empty, str(tmp_path / "none"), measure).count() == 0


def test_aligned_files_in_bundles(spark, tmp_path, monkeypatch):
    """Each name was a folder and a file of its own."""
    from quarry.plans import dumps as P

    for folder, lines in (("tok", ["1\ta b c", "2\tx y", "3\t", "4\tz"]), ("lab", ["2\t0", "1\t0,1,1", "3\t"])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "part").write_text("\n".join(lines))
    got = D.read_aligned(spark, f"file://{tmp_path}/tok", f"file://{tmp_path}/lab", bundled=True).collect()
    assert sorted((r.doc, r.position, r.token, r.label) for r in got if r.error is None) == [("1", 0, "a", "0"), ("1", 1, "b", "1"), ("1", 2, "c", "1")]
    assert sorted((r.doc, r.position, r.token) for r in got if r.error) == [("2", None, None), ("4", None, None)]

    texts = spark.range(3000).selectExpr("id as doc_id", "case when id = 7 then null when id = 8 then '-- ' when id = 9 then repeat('Äb,c\n', 90) else concat(' x', id, '; ß!') end as text")
    texts.write.parquet(f"file://{tmp_path}/documents.parquet")
    monkeypatch.setattr(P, "_place", lambda spark: f"file://{tmp_path}/dump-{len(list(tmp_path.glob('dump-*')))}")
    rows = P.aligned_files(spark, f"file://{tmp_path}").collect()
    assert len({r.doc for r in rows}) == 60 and {r.doc for r in rows if r.error} == {str(k) for k in range(60) if k % 9 == 4}
    first = [(r.token, r.label) for r in sorted((r for r in rows if r.doc == "0"), key=lambda r: r.position)]
    assert first[:4] == [("x0", "2"), ("ß", "1"), ("x1", "2"), ("ß", "1")] and first[14:54] == [("Äb", "2"), ("c", "1")] * 20 and len(first) == 7 * 2 + 40 + 40 * 2
    assert 2 <= len(list(tmp_path.glob("dump-*/*/**/*.txt"))) < 20
