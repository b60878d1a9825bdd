"""Cutting texts by their sections, by hand."""

from pyspark.sql import functions as F

from quarry.operators.sections import trim_sections


def _cut(spark, text, budget, **kw):
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    return trim_sections(rows, "text", budget, **kw).first().text


def test_within_budget_and_odd_texts_stay(spark):
    assert _cut(spark, "## References\nabc", 100) == "## References\nabc"
    assert _cut(spark, None, 10) is None and _cut(spark, "", 10) == ""
    assert _cut(spark, "no heading at all", 5) == "no he"
    assert _cut(spark, "## Funding\nabcdef\n## References\nabcdef", 5, keep_first=False) == ""


def test_skip_order_and_slack(spark):
    text = "lead\n## Methods\n" + "m" * 40 + "\n## Results\n" + "r" * 40 + "\n## Funding\nnone\n"
    # three sections share 60: 20 each; the lead of 5 leaves 15, which go to the results first
    got = _cut(spark, text, 60)
    assert got == "lead\n" + ("## Results\n" + "r" * 40)[:35] + ("## Methods\n" + "m" * 40)[:20]


def test_score_takes_the_place_of_names(spark):
    text = "lead\n## Results\n" + "r" * 30 + "\n## Other\n" + "7 " * 15
    got = _cut(spark, text, 40, score=lambda s: F.regexp_count(s, F.lit("7")).cast("double"))
    assert got.startswith("lead\n## Other\n7 7") and got.index("## Other") < got.index("## Results") and len(got) == 40
