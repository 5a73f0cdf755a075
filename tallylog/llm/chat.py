"""Chat formatting by perspective rotation.

Every participant of a conversation (each distinct role but ``system``) takes the assistant's seat once: the dialogue is
rendered with that speaker as assistant, all others as named users and system turns as such, and only the assistant's turns
are trained on. The result is one row per perspective and turn, with the place of the segment in the rendered dialogue, so
the dialogue of a perspective is the segments in order of ``position``; no conversation is ever gathered into one task. Turn
order inside a conversation comes from sums over stretches of STRETCH turn numbers, then within each stretch.

Defined cases: turns are ordered by turn, role, text (nulls first), ties and repeated rows stay; a null role is the speaker
``unknown``; a null text is empty; a null conv_id is a conversation of its own; a conversation with system turns alone has no
participant and no row. Special tokens inside a text, or in the name of a user, are broken by a space after ``<|``. Texts
of any length are rendered in their own rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turn numbers that are ordered together.
STRETCH = 256
UNKNOWN, SYSTEM = "unknown", "system"


def _plain(text: Column) -> Column:
    """Text that holds no special token."""
    return F.replace(text, F.lit("<|"), F.lit("<| "))


def _header(role: Column, speaker: Column) -> Column:
    named = F.concat(F.lit("<|user|>"), _plain(role), F.lit(": "))
    return F.when(role == SYSTEM, F.lit("<|system|>")).when(role == speaker, F.lit("<|assistant|>")).otherwise(named)


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, speaker, position (long, from 0), turn, role, segment, train, start and mask_start, mask_end (characters).

    ``start`` is the segment's first character in the dialogue of the speaker, whose segments lie end to end; the characters
    from mask_start up to mask_end are trained on (none if equal).
    """
    said = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.when(F.col("role") != "", F.col("role")), F.lit(UNKNOWN)).alias("role"),
        _plain(F.coalesce("text", F.lit(""))).alias("said"),
        F.floor(F.col("turn") / STRETCH).alias("stretch"),
    )
    speakers = said.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    seats = said.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    end = "<|end|>\n"
    seats = seats.withColumn("header", _header(F.col("role"), F.col("speaker")))
    seats = seats.withColumn("segment", F.concat("header", "said", F.lit(end))).withColumn("width", F.length("segment").cast("long"))
    key = ["conv_id", "speaker"]
    sums = seats.groupBy(*key, "stretch").agg(F.sum("width").alias("w"), F.count("*").alias("n"))
    before = sums.selectExpr(
        "conv_id AS c", "speaker AS s", "stretch AS k",
        "sum(w) OVER (PARTITION BY conv_id, speaker ORDER BY stretch NULLS FIRST) - w AS chars",
        "sum(n) OVER (PARTITION BY conv_id, speaker ORDER BY stretch NULLS FIRST) - n AS turns",
    )
    inner = "PARTITION BY conv_id, speaker, stretch ORDER BY turn NULLS FIRST, role, said ROWS UNBOUNDED PRECEDING"
    local = seats.selectExpr("*", f"sum(width) OVER ({inner}) - width AS chars_in", f"row_number() OVER ({inner}) - 1 AS turns_in")
    placed = local.join(before, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("speaker") == F.col("s")) & F.col("stretch").eqNullSafe(F.col("k")))
    start = F.col("chars") + F.col("chars_in")
    train = F.col("role") == F.col("speaker")
    body = start + F.length("header")
    return placed.select(
        *key,
        (F.col("turns") + F.col("turns_in")).alias("position"),
        "turn",
        "role",
        "segment",
        train.alias("train"),
        start.alias("start"),
        F.when(train, body).otherwise(start + F.col("width")).alias("mask_start"),
        (start + F.col("width")).alias("mask_end"),
    )
