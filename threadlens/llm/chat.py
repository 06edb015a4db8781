"""Operator 8: chat formatting by multi-party perspective rotation.

A dialogue is rendered once for each of its participants: that speaker is the assistant, every other one a user
with a name, system turns stay system turns, and only the assistant's words are trained on. The result is
long: one row for each turn and perspective, with the rendered segment, its place in the rendered dialogue
(``start``, ``stop``, in characters) and the part that the loss covers (``mask_start``, ``mask_stop``, null where
nothing is trained). The dialogue is the segments in the order of ``start``. Dialogues may hold a third of all
turns, so none is gathered: places come from running sums over ranges of (dialogue, turn), which split a long
dialogue over many tasks, and participants from an aggregate with map-side combine.

Main path: DataFrame functions only. Defined results: a null speaker is ``unknown``; a null text is empty; a null
turn sorts first; repeated rows are turns of their own, and turns of equal number follow each other by speaker and
digest of the text; rows with a null conversation id are one dialogue; a dialogue of system turns only has no
participant and no row. Control marks within texts and names are broken with a backslash; names keep letters, digits,
``_``, ``-`` and ``.`` (others become ``_``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import quoted
from threadlens.operators.skew import running_total

SYSTEM = "system"
UNKNOWN = "unknown"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def _name(speaker: Column) -> Column:
    return F.regexp_replace(speaker, r"[^\p{L}\p{N}_.\-]", "_")


def rotate(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    speaker_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, start, stop, mask_start, mask_stop."""
    rows = turns.select(
        # a struct, so that a null id is a dialogue like others in joins and groups
        F.struct(quoted(conv_col).alias("conv_id")).alias("conv"),
        quoted(turn_col).alias("turn"),
        F.coalesce(quoted(speaker_col).cast("string"), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
    )
    people = rows.where(F.col("speaker") != SYSTEM).select("conv", F.col("speaker").alias("perspective")).distinct()
    views = rows.join(people, "conv")
    mine = F.col("speaker") == F.col("perspective")
    header = (
        F.when(F.col("speaker") == SYSTEM, F.lit("<|im_start|>system\n"))
        .when(mine, F.lit("<|im_start|>assistant\n"))
        .otherwise(F.concat(F.lit("<|im_start|>user name="), _name(F.col("speaker")), F.lit("\n")))
    )
    body = F.concat(_plain(F.col("text")), F.lit("<|im_end|>"))
    views = views.select(
        "conv", "perspective", "turn", "speaker", F.md5(F.col("text").cast("binary")).alias("mark"),
        F.concat(header, body, F.lit("\n")).alias("segment"),
        F.when(mine, F.length(header)).alias("skip"), F.when(mine, F.length(body)).alias("trained"),
    )
    placed = running_total(views, ["conv", "perspective"], ["turn", "speaker", "mark"], F.length("segment"), "start")
    skip = F.col("start") + F.col("skip")
    return placed.select(
        F.col("conv.conv_id").alias("conv_id"),
        "perspective",
        "turn",
        "speaker",
        "segment",
        "start",
        (F.col("start") + F.length("segment")).alias("stop"),
        skip.alias("mask_start"),
        (skip + F.col("trained")).alias("mask_stop"),
    )


SQL = """
with t as (
  select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations
), people as (
  select distinct conv_id, speaker as perspective from t where speaker <> 'system'
), v as (
  select t.conv_id, p.perspective, t.turn, t.speaker, md5(t.text) as mark,
    case when t.speaker = 'system' then '<|im_start|>system' || chr(10)
      when t.speaker = p.perspective then '<|im_start|>assistant' || chr(10)
      else '<|im_start|>user name=' || regexp_replace(t.speaker, '[^\\p{L}\\p{N}_.\\-]', '_', 'g') || chr(10) end as header,
    replace(t.text, '<|', '<\\|') || '<|im_end|>' as body
  from t join people p on t.conv_id is not distinct from p.conv_id
), placed as (
  select *, coalesce(sum(length(header) + length(body) + 1) over (partition by conv_id, perspective
    order by turn nulls first, speaker, mark rows between unbounded preceding and 1 preceding), 0)::bigint as start from v
)
select conv_id, perspective, turn, speaker, header || body || chr(10) as segment, start,
  start + length(header) + length(body) + 1 as stop,
  case when speaker = perspective then start + length(header) end as mask_start,
  case when speaker = perspective then start + length(header) + length(body) end as mask_stop
from placed
"""
