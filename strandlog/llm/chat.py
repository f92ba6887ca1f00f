"""op7: dialogues rendered from every participant's perspective."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Roles that are shown to everybody and have no perspective of their own; what a missing role is called.
CONTEXT, UNKNOWN = ("system",), "unknown"
#: A dialogue is rendered in parts of so many turn numbers, so that none is too long for a row.
PART = 4096
#: What begins a marker, and what stands for it inside a text or name.
OPEN, ESCAPED, END = "<|", "<\\|", "<|end|>\n"

SQL = r"""WITH t AS (
  SELECT conv_id, CAST(coalesce(turn, 0) // 4096 AS BIGINT) AS part, turn, coalesce(role, 'unknown') AS role, role AS own_role, replace(coalesce(text, ''), '<|', '<\|') AS body FROM conversations
), p AS (SELECT DISTINCT conv_id, own_role AS perspective FROM t WHERE own_role <> 'system'),
r AS (
  SELECT t.conv_id, perspective, part, turn, role, body, own_role = perspective AS own,
    CASE WHEN own_role = perspective THEN '<|assistant|>' || chr(10) WHEN role = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || replace(role, '<|', '<\|') || '|>' || chr(10) END AS head,
    body || '<|end|>' || chr(10) AS tail
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), o AS (
  SELECT *, CAST(sum(len(head) + len(tail)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, role, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM r
)
SELECT conv_id, perspective, part, count(*) AS n_turns, CAST(count(*) FILTER (own) AS BIGINT) AS n_own, string_agg(head || tail, '' ORDER BY stop) AS rendered,
  coalesce(string_agg((stop - len(tail)) || '-' || stop, ',' ORDER BY stop) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, perspective, part"""


def _escaped(c: Column) -> Column:
    return F.replace(c, F.lit(OPEN), F.lit(ESCAPED))


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT) -> DataFrame:
    """A row for each participant of each dialogue part: (conv_id, perspective, part, n_turns, n_own, rendered, spans).

    turns: (conv_id, turn, role, text; further columns don't matter). In the rendering for a participant its turns are the
    assistant's, those of context roles the system's, and all others a user's with the speaker's name. spans: (start, stop)
    in characters of what is to be trained on, the assistant's texts with the marker that ends them.

    Turns go by turn (null first), then role and text, so ties and repeated rows have a place each; consecutive turns aren't
    merged. A null text is empty; a null role is a user called `unknown` without a perspective; a null conv_id is a dialogue
    of its own. Markers inside texts and names are escaped. A dialogue with one speaker has one rendering, one with context
    roles only none. n participants give n renderings, so the output is n times the dialogue; a dialogue is cut into parts of
    PART turn numbers, which bounds a row as long as turn numbers aren't repeated without end.
    """
    t = turns.select(
        "conv_id", F.floor(F.coalesce("turn", F.lit(0)) / PART).alias("part"),
        F.struct(F.col("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("role"), _escaped(F.coalesce("text", F.lit(""))).alias("body"), F.col("role").alias("own")).alias("t"),
    )
    parts = t.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    speakers = turns.where(F.col("role").isNotNull() & ~F.col("role").isin(*context)).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    both = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c")))
    own = lambda x: x["own"].eqNullSafe(F.col("perspective"))
    head = lambda x: F.when(own(x), F.lit("<|assistant|>\n")).when(x["role"].isin(*context), F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user name="), _escaped(x["role"]), F.lit("|>\n")))
    shown = F.transform("turns", lambda x: F.struct(own(x).alias("own"), head(x).alias("head"), F.concat(x["body"], F.lit(END)).alias("tail")))
    rows = both.select("conv_id", "perspective", "part", shown.alias("shown"))
    # (where the text is now, the spans so far)
    walk = F.aggregate(
        "shown",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["tail"])).alias("at"),
            F.when(x["own"], F.array_append(a["spans"], F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["tail"])).alias("stop")))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return rows.select(
        "conv_id", "perspective", "part", F.size("shown").cast("long").alias("n_turns"), F.size(F.filter("shown", lambda x: x["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("shown", lambda x: F.concat(x["head"], x["tail"])), "").alias("rendered"), walk["spans"].alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans as text, start-stop joined by commas."""
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("mask", mask).drop("spans")
