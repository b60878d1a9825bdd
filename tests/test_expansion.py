"""Seeds and what their citations bring, by hand."""

from quarry.operators.rank import choose_seeds, expand_seeds


def test_seeds_fall_back_to_the_nearest(spark):
    rows = [(1, k, k, c) for k, c in enumerate((0.9, 0.29, 0.31, 0.1, 0.5))] + [(2, k, k, 0.1) for k in range(6)]
    got = choose_seeds(spark.createDataFrame(rows, "topic_id long, ev_id long, arrival long, cosine double")).collect()
    assert {r.ev_id for r in got if r.topic_id == 1} == {0, 2, 4}
    assert {r.ev_id for r in got if r.topic_id == 2} == {0, 1, 2, 3}


def test_related_from_the_first_doi_and_nothing_seen_twice(spark):
    seeds = [
        (1, 10, 1, "https://pubmed.ncbi.nlm.nih.gov/12345/", "pubmed"), (1, 11, 2, "https://doi.org/10.1000/a", "europe_pmc"),
        (1, 12, 3, "https://doi.org/10.1000/b", "pubmed"), (1, 13, 4, "https://who.int/x", "who_gho"),
    ]
    edges = [(10, 20, 2, "references"), (10, 13, 2, "references"), (11, 21, 4, "related"), (12, 22, 4, "related"), (11, 20, 3, "citations"), (13, 23, 2, "references"), (10, 24, 4, "related"), (12, 25, 2, "references")]
    records = [(k, f"https://e.org/{k}/") for k in (20, 21, 22, 23, 24)] + [(13, "https://WHO.int/x/"), (25, None)]
    out = expand_seeds(
        spark.createDataFrame(seeds, "topic_id long, ev_id long, seed_rank int, url string, source_type string"), spark.createDataFrame(edges, "src long, dst long, kind_no int, kind string"),
        spark.createDataFrame(records, "ev_id long, url string"),
    )
    assert sorted((r.place, r.seed, r.ev_id) for r in out.collect()) == [(1, 10, 20), (2, 11, 21)]
