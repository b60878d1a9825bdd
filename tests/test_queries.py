"""What providers are asked, field by field."""

from pyspark.sql import functions as F

from quarry.functions import queries as Q
from quarry.operators.findings import classify


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_literature_queries(spark):
    df = rows(
        spark, "q string, mesh array<string>, drugs array<string>, diseases array<string>, kind string",
        ("aspirin[tiab]", ["Heart"], [], [], "review"), ("what is the best drug, really", ["Heart", "Lung", "Liver", "Skin"], [], [], None), ("of the", ["Heart"], [], [], "odd"), ("more about stroke prevention", [], ["Aspirin", "b", "c"], [], None),
        ("more about stroke", [], ["Aspirin"], ["Stroke", "Pain"], "rct"), ("one (two)", [], [], [], None), ("alpha beta gamma delta epsilon zeta eta", [], [], [], "guideline"), ("of the", [], [], [], "rct"),
    )
    got = [r.x for r in df.select(Q.literature_query(*(F.col(c) for c in df.columns)).alias("x")).collect()]
    assert got == [
        "(aspirin[tiab]) AND review[pt]", '("Heart"[Majr] AND "Lung"[MeSH Terms] AND "Liver"[MeSH Terms]) AND (best[tiab] AND drug[tiab] AND really[tiab])', '"Heart"[Majr]',
        '(("Aspirin"[tiab] OR "b"[tiab])) AND (stroke prevention[tiab])', '(("Aspirin"[tiab]) AND ("Stroke"[tiab] OR "Pain"[tiab])) AND randomized controlled trial[pt]', "one[tiab] AND two[tiab]",
        "((alpha[tiab] AND beta[tiab] AND gamma[tiab]) AND (delta epsilon zeta)) AND (practice guideline[pt] OR guideline[pt])", "of the",
    ]


def test_main_query_falls_back(spark):
    schema = "given string, pico struct<population: string, intervention: string, comparison: string, outcome: string>, subject string, value string, text string"
    df = rows(spark, schema, (" g ", None, "s", "v", "t"), ("", ("p", "i", " ", None), "s", None, "t"), (None, (None, "i", None, None), " s ", "v", "t"), (None, None, " ", None, "t" * 90))
    assert [r.x for r in df.select(Q.main_query(*(F.col(c) for c in df.columns)).alias("x")).collect()] == ["g", "p i", "s v", "t" * 60]


def test_options_names_and_keywords(spark):
    df = rows(spark, "kind string, subject string, q string, provider string", ("dosage", " Aspirin ", "what is the dose of aspirin?", "ema"), ("prevalence", "flu", "cases in 2020", "openfda"), ("definition", "", "Mechanism of action (warfarin sodium tablets x)", "pubmed"))
    options = Q.topic_options(F.col("kind"), F.col("subject"))
    got = df.select(*(c.alias(n) for n, c in options.items() if n != "kind"), options["kind"].alias("answer"), Q.with_subject(F.col("q"), F.col("provider"), F.col("subject")).alias("named"), Q.drug_name(F.col("q")).alias("name"), Q.with_keywords(F.col("q"), F.array(F.lit("Cases"), F.lit("who"))).alias("more")).collect()
    assert [(r.drugs, r.answer, r.prefer_reviews, r.recent_only) for r in got] == [(["Aspirin"], "guideline", False, False), ([], None, False, True), ([], None, True, False)]
    assert [r.named for r in got] == ["what is the dose of aspirin?", "flu cases in 2020", "Mechanism of action (warfarin sodium tablets x)"]
    assert [r.name for r in got] == ["aspirin", "cases 2020", "warfarin sodium tablets"]
    assert [r.more for r in got] == ["what is the dose of aspirin? Cases who", "cases in 2020 who", "Mechanism of action (warfarin sodium tablets x) Cases who"]
    terms = rows(spark, "a array<string>", (['"x y"[MeSH Terms] OR "z"[MeSH Terms]', '"z"[MeSH Terms] "w"[tiab]'],))
    assert terms.select(Q.vocabulary_terms(F.col("a")).alias("x")).first().x == ["x y", "z"]


def test_two_propositions(spark):
    df = rows(spark, "s double, c double", (0.5, 0.4), (0.6, 0.6), (0.2, 0.9), (0.3, 0.1))
    got = df.select(*(c.alias(n) for n, c in classify(F.col("s"), F.col("c")).items())).collect()
    assert [tuple(r) for r in got] == [("SUPPORT", 0.5), ("NOINFO", 0.4), ("CONTRADICT", 0.9), ("NOINFO", 0.7)]
