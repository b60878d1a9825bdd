"""Dialogues rendered from the view of each participant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.storage import materialise

#: Fixed values of the rendering.
OPEN, CLOSE, END = "<|", "|>", "<|end|>\n"


def rotate_perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    system_role: str = "system", piece_turns: int = 512,
) -> DataFrame:
    """A rendering of every conversation for every participant, in DataFrame functions only.

    A participant is a distinct non-null speaker other than ``system_role``. In its rendering its own turns are
    ``assistant``, all others ``user`` with the speaker's name, system turns stay ``system``; only
    its own turns are masked in for training: their text and closing mark, not their header.
    A turn is rendered as ``<|assistant|>\\n``, ``<|user name=X|>\\n`` or ``<|system|>\\n``, then the text, then
    ``<|end|>\\n``; a null speaker is a user without a name, and null texts are empty. Turns are ordered
    by number (nulls first) and, where numbers tie, by speaker and text; repeated rows are kept. Whatever the numbers are, a long
    conversation is spread over tasks, but for turns that are equal up to the first 256 characters of their text.

    One row for each (conversation, speaker, piece): a conversation is dealt in pieces of ``piece_turns`` turns, so that
    neither a task nor a row holds an unbounded one; most have the single piece 0, and a longer rendering is the
    concatenation of its pieces. Columns: conv_id, speaker, piece long, n_turns long, n_own long (turns
    of the speaker in the piece), n_masked long (characters), rendered string, mask_starts and
    mask_ends (arrays of long: character offsets in ``rendered``, from 0, end exclusive). A conversation without
    a participant gives no rows; one with a null id counts as one conversation; an empty table none.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    # where a turn falls: all turns are dealt by ranges of their order and written, so a conversation of any size lies in pieces one after another, and
    # a turn's place is its place in the piece and what the pieces before it hold
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 256)).sortWithinPartitions("conv_id", "turn", "role", "text")
    placed = materialise(dealt.select("conv_id", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "turns")
    parts = placed.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.min("row").alias("first"), F.count("*").alias("here"))
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).drop("here", "first")
    speakers = placed.filter(F.col("role").isNotNull() & (F.col("role") != system_role)).select(F.col("conv_id").alias("s"), F.col("role").alias("speaker")).distinct()
    # written first, so that both sides of the join are plain exchanges
    seen = materialise(parts.join(speakers, F.col("c").eqNullSafe(F.col("s"))).drop("s"), "speakers")
    viewed = placed.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumn("position", F.col("row") + F.col("start"))
    own = F.col("role").eqNullSafe(F.col("speaker"))
    header = (
        F.when(own, F.lit(f"{OPEN}assistant{CLOSE}\n")).when(F.col("role") == system_role, F.lit(f"{OPEN}system{CLOSE}\n")).when(F.col("role").isNull(), F.lit(f"{OPEN}user{CLOSE}\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), F.col("role"), F.lit(f"{CLOSE}\n")))
    )
    body = F.concat("text", F.lit(END))
    pieces = viewed.groupBy("conv_id", "speaker", F.floor(F.col("position") / piece_turns).alias("piece")).agg(
        F.sort_array(F.collect_list(F.struct("position", header.alias("header"), body.alias("body"), own.alias("own")))).alias("t")
    )
    # lengths accumulate over the turns of a piece, at most piece_turns of them
    ends = F.aggregate(
        "t", F.array().cast("array<bigint>"),
        lambda acc, t: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + (F.length(t["header"]) + F.length(t["body"])).cast("bigint"))),
    )
    marked = pieces.withColumn("e", ends).withColumn("own", F.filter(F.arrays_zip("t", "e"), lambda x: x["t"]["own"]))
    return marked.select(
        "conv_id", "speaker", F.col("piece").cast("long").alias("piece"), F.size("t").cast("long").alias("n_turns"), F.size("own").cast("long").alias("n_own"),
        F.aggregate("own", F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x["t"]["body"]).cast("bigint")).alias("n_masked"),
        F.array_join(F.transform("t", lambda t: F.concat(t["header"], t["body"])), "").alias("rendered"),
        F.transform("own", lambda x: x["e"] - F.length(x["t"]["body"])).alias("mask_starts"), F.transform("own", lambda x: x["e"]).alias("mask_ends"),
    )


def perspectives_sql(piece_turns: int = 512) -> str:
    """The rows of the registered query in DuckDB SQL."""
    return f"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS position FROM t),
    s AS (SELECT DISTINCT conv_id, role AS speaker FROM p WHERE role IS NOT NULL AND role <> 'system'),
    v AS (SELECT p.conv_id, speaker, position // {piece_turns} AS piece, position, role IS NOT DISTINCT FROM speaker AS own, text || '<|end|>' || chr(10) AS body,
          CASE WHEN role IS NOT DISTINCT FROM speaker THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' WHEN role IS NULL THEN '<|user|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS header
          FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
    e AS (SELECT *, sum(length(header) + length(body)) OVER (PARTITION BY conv_id, speaker, piece ORDER BY position) AS stop FROM v)
    SELECT conv_id, speaker, CAST(piece AS BIGINT) AS piece, count(*) AS n_turns, count(*) FILTER (own) AS n_own, CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_masked,
           string_agg(header || body, '' ORDER BY position) AS rendered,
           coalesce(string_agg((stop - length(body)) || '-' || stop, ',' ORDER BY position) FILTER (own), '') AS mask
    FROM e GROUP BY conv_id, speaker, piece
    """

