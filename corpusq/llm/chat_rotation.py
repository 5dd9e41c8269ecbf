"""Multi-party perspective rotation of dialogues, in DataFrame functions only.

Every participant of a conversation takes the assistant's part once: its own
turns become ``assistant`` and carry the loss mask, all other speakers become
named users. Context speakers (``system``) are nobody's perspective and keep
their own tag.

A rendered part holds the turns of one span of ``part_turns`` turn numbers, so a
conversation of any length is dealt out over many groups; the parts of a
perspective, in the order of ``part``, are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTEXT = ("system",)
PART_TURNS = 256
UNNAMED = "unknown"


def rotate(turns: DataFrame, context: tuple[str, ...] = CONTEXT, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each turn and perspective: conv_id, perspective, turn, speaker, segment, head, masked.

    ``segment`` is the turn as rendered; where ``masked`` holds, the characters
    after the first ``head`` are trained on. Null or blank roles are the speaker
    "unknown", null texts are empty, a null conv_id is a conversation of its own,
    repeated rows stay repeated. A conversation of context turns only has no
    participant and gives no row. ``<|`` in a text or a name is written ``< |``, so no text
    can open a turn. Other columns are not read.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.trim(F.coalesce(F.col(role).cast("string"), F.lit("")))
    said = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.when(name == "", UNNAMED).otherwise(safe(name)).alias("speaker"),
        safe(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("said"),
    )
    people = said.where(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(F.col("speaker").isin(*context), F.concat(F.lit("<|"), F.col("speaker"), F.lit("|>\n")))
        .when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), F.col("speaker"), F.lit("|>\n")))
    )
    return (
        said.join(people, said.conv_id.eqNullSafe(people.conv))
        .select("conv_id", "perspective", "turn", "speaker", F.concat(head, F.col("said"), F.lit("<|end|>\n")).alias("segment"), F.length(head).alias("head"), own.alias("masked"))
    )


def render(turns: DataFrame, context: tuple[str, ...] = CONTEXT, part_turns: int = PART_TURNS, **columns: str) -> DataFrame:
    """One row for each conversation, perspective and part: conv_id, perspective, part, n_turns, n_masked, n_chars, text, mask.

    ``mask`` lists the trained character spans of ``text``, ``start-end`` with the
    end left out, joined by commas. Turns go by number (nulls in part -1), ties by
    speaker, then text. See ``rotate`` for nulls and repeats.
    """
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    keys = ["conv_id", "perspective", "part"]
    order = Window.partitionBy(*keys).orderBy(F.col("turn").asc_nulls_first(), "speaker", "segment")
    laid = (
        rotate(turns, context, **columns).withColumn("part", part)
        .withColumn("at", F.row_number().over(order))
        .withColumn("end", F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    span = F.concat_ws("-", F.col("end") - F.length("segment") + F.col("head"), F.col("end") - 1)
    listed = lambda c: F.array_sort(F.collect_list(c))
    return laid.groupBy(*keys).agg(
        F.count("*").alias("n_turns"), F.sum(F.col("masked").cast("long")).alias("n_masked"), F.max("end").alias("n_chars"),
        F.array_join(F.transform(listed(F.struct("at", "segment")), lambda x: x["segment"]), "").alias("text"),
        F.array_join(F.transform(listed(F.when(F.col("masked"), F.struct("at", span.alias("span")))), lambda x: x["span"]), ",").alias("mask"),
    )


ORACLE = """
WITH said AS (
  SELECT conv_id, turn, CASE WHEN trim(coalesce(role, '')) = '' THEN 'unknown' ELSE replace(trim(role), '<|', '< |') END AS speaker,
         replace(coalesce(text, ''), '<|', '< |') AS said
  FROM conversations),
people AS (SELECT DISTINCT conv_id AS conv, speaker AS perspective FROM said WHERE speaker <> 'system'),
turned AS (
  SELECT conv_id, perspective, turn, speaker, said, speaker = perspective AS masked,
         CASE WHEN speaker = 'system' THEN '<|system|>' || chr(10) WHEN speaker = perspective THEN '<|assistant|>' || chr(10)
              ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM conv),
laid AS (SELECT *, head || said || '<|end|>' || chr(10) AS segment, coalesce(turn // 256, -1) AS part FROM turned),
placed AS (
  SELECT *, row_number() OVER w AS pos, sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS "end"
  FROM laid WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn NULLS FIRST, speaker, segment))
SELECT conv_id, perspective, CAST(part AS BIGINT) AS part, count(*) AS n_turns, CAST(sum(CAST(masked AS BIGINT)) AS BIGINT) AS n_masked, CAST(max("end") AS BIGINT) AS n_chars,
       string_agg(segment, '' ORDER BY pos) AS text,
       coalesce(string_agg(CAST("end" - length(segment) + length(head) AS BIGINT) || '-' || CAST("end" - 1 AS BIGINT), ',' ORDER BY pos) FILTER (WHERE masked), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
