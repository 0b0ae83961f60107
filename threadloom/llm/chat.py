"""Multi-party perspective rotation: every participant's view of a dialogue, with training masks.

A rendering is made of segments of SEGMENT turn numbers, so that one very long conversation is rendered by many tasks;
concatenated in order they are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 256


def rotate(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """A row for each conversation, participant and segment, with columns

    conv_id, speaker, segment, n_turns, n_masked (turns the speaker is to learn), rendered, and mask_starts/mask_ends:
    the spans of `rendered` (0-based, in characters, end excluded) that hold the speaker's own texts, in order.

    Turns by the speaker are the assistant's; others are users with their name. Turns go by (turn, role, text), nulls
    first; rows that repeat another wholly are one turn. A null role is "unknown", a null text is empty, and rows with a
    null conv_id form one conversation. "<|" inside names and texts becomes "< |", so that a text can't open a turn.
    """
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    turns = (
        conversations.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .distinct()
        .withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment), F.lit(0)).cast("long"))
    )
    speakers = turns.select("conv_id", F.col("role").alias("speaker")).distinct().withColumnRenamed("conv_id", "c")
    own = F.col("role") == F.col("speaker")
    views = (
        turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
        .withColumn("head", F.when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user name="), plain("role"), F.lit("|>\n"))))
        .withColumn("body", plain("text"))
        .withColumn("own", own)
    )
    group = ["conv_id", "speaker", "segment"]
    upto = Window.partitionBy(*group).orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = views.withColumn("stop", F.sum(F.length("head") + F.length("body") + 1).over(upto) - 1).withColumn("nth", F.count(F.lit(1)).over(upto))
    span = F.struct("nth", (F.col("stop") - F.length("body")).alias("start"), F.col("stop").alias("end"))
    return (
        placed.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("n_turns"),
            F.count_if("own").alias("n_masked"),
            F.array_sort(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit("\n")).alias("part")))).alias("parts"),
            F.array_sort(F.collect_list(F.when(F.col("own"), span))).alias("spans"),
        )
        .select(
            *group, "n_turns", "n_masked",
            F.array_join("parts.part", "").alias("rendered"),
            F.col("spans.start").alias("mask_starts"),
            F.col("spans.end").alias("mask_ends"),
        )
    )


#: The same in DuckDB's SQL; lists are text there and in query op4, as the comparison hashes scalar values.
ORACLE = """
with turns as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    coalesce(cast(floor(turn / 256.0) as bigint), 0) as segment
  from conversations),
speakers as (select distinct conv_id as c, role as speaker from turns),
views as (
  select conv_id, segment, turn, role, text, speaker, role = speaker as own,
    case when role = speaker then '<|assistant|>' || chr(10) else '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) end as head,
    replace(text, '<|', '< |') as body
  from turns join speakers on conv_id is not distinct from c),
placed as (
  select *, row_number() over w as nth,
    sum(length(head) + length(body) + 1) over (w rows unbounded preceding) - 1 as stop
  from views window w as (partition by conv_id, speaker, segment order by turn nulls first, role, text))
select conv_id, speaker, segment, count(*) as n_turns, count(*) filter (own) as n_masked,
  string_agg(head || body || chr(10), '' order by nth) as rendered,
  coalesce(string_agg(cast(cast(stop - length(body) as bigint) as varchar), ',' order by nth) filter (own), '') as mask_starts,
  coalesce(string_agg(cast(cast(stop as bigint) as varchar), ',' order by nth) filter (own), '') as mask_ends
from placed group by conv_id, speaker, segment
"""
