"""Looking queries up in a register of products by weighted fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.retrieve import top_per_group
from quarry.storage import broadcast_if_small

#: What a match in each field is worth, and words that tell nothing about a product.
FIELD_WEIGHTS = {"name": 3.0, "substance": 4.0, "area": 1.5, "indication": 0.5}
WHOLE_NAME, CODE, UNAUTHORISED, FLOOR = 6.0, 4.0, 0.6, 0.4
REGISTER_STOPWORDS = (
    "the", "and", "for", "with", "what", "how", "does", "drug", "medicine", "medicinal", "product", "treatment", "therapy", "use", "used", "uses",
    "approved", "authorised", "authorized", "approval", "europe", "european", "eu", "ema", "che", "cosa", "come", "per", "con", "del", "della", "dei",
    "delle", "farmaco", "farmaci", "medicinale", "trattamento", "terapia", "indicazione", "indicazioni", "uso", "approvato", "autorizzato", "europa", "europea",
)
CODE_PATTERN = "^[a-z][0-9]{2}[a-z]{0,2}[0-9]{0,2}$"
WORD_BREAK = r"[^\p{L}\p{N}_]+"
LEAST = 3


def terms(text: Column) -> Column:
    """Words of a query that may tell something, repeats included."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) >= LEAST) & ~w.isin(*REGISTER_STOPWORDS))


def _postings(register: DataFrame) -> DataFrame:
    """id, term, weight, only_code: every beginning of a word that a term could match, once for each field."""
    fields = F.array(*(F.struct(F.lit(w).alias("weight"), F.lower(F.coalesce(F.col(f), F.lit(""))).alias("value")) for f, w in FIELD_WEIGHTS.items()))
    words = register.select("id", F.explode(fields).alias("f")).select("id", "f.weight", F.explode(F.array_distinct(F.split("f.value", WORD_BREAK))).alias("word"))
    head = words.select("id", "weight", F.regexp_extract("word", "^[a-z0-9]+", 0).alias("head")).filter(F.length("head") >= LEAST)
    starts = head.select("id", "weight", F.explode(F.transform(F.sequence(F.lit(LEAST), F.length("head")), lambda n: F.substring("head", F.lit(1), n))).alias("term")).distinct()
    whole = register.select("id", F.lit(WHOLE_NAME - FIELD_WEIGHTS["name"]).alias("weight"), F.lower("name").alias("term")).filter("term IS NOT NULL")
    code = register.select("id", F.lower("code").alias("code")).filter(F.length("code") >= LEAST)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("code") - LEAST + 1), lambda a: F.transform(F.sequence(F.lit(LEAST), F.length("code") - a + 1), lambda n: F.substring("code", a, n))))
    codes = code.select("id", F.lit(CODE).alias("weight"), F.explode(F.array_distinct(spans)).alias("term")).filter(F.col("term").rlike(CODE_PATTERN))
    return starts.unionByName(whole).unionByName(codes)


def register_search(queries: DataFrame, register: DataFrame, most: int = 3) -> DataFrame:
    """The ``most`` best records of each query: query_id, id, score, place.

    A term matches a field at the beginning of one of its words; a term that looks like a classification code also matches
    inside the code. A record's score is the mean over the query's terms, less for records not authorised, and counts
    from 0.4. Equal scores: authorised first, then reference products, then the newest, undated last, then the smaller id.
    ``queries``: query_id, text; ``register``: id, name, substance, code, area, indication, authorised, reference, updated.

    Words' beginnings meet terms by equality, after those that no query asks for are gone; sums are folded before they are shuffled.
    A record with nulls matches by what it has; queries without terms find nothing.
    """
    asked = queries.select("query_id", terms(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    asked = asked.select("query_id", "n", F.explode("t").alias("term")).groupBy("query_id", "n", "term").agg(F.count("*").alias("times"))
    wanted = broadcast_if_small(asked.select("term").distinct(), 1_000_000)
    found = _postings(register).join(wanted, "term").join(asked, "term").groupBy("query_id", "id", "n").agg(F.sum(F.col("weight") * F.col("times")).alias("total"))
    rows = found.join(register.select("id", "authorised", "reference", "updated"), "id")
    score = F.col("total") / F.col("n") * F.when(F.coalesce("authorised", F.lit(False)), 1.0).otherwise(UNAUTHORISED)
    kept = rows.withColumn("score", F.round(score, 6)).filter(score >= FLOOR)
    order = [F.desc("score"), F.desc(F.coalesce("authorised", F.lit(False))), F.desc(F.coalesce("reference", F.lit(False))), F.desc_nulls_last("updated"), "id"]
    return top_per_group(kept, ["query_id"], order, most, "place").select("query_id", "id", "score", "place")
