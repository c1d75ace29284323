"""Context of a dialogue turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from guestlens.operators.ranking import group_positions

CONTEXT_TURNS = 10
SPOKEN = ("user", "assistant")


def recent_context(turns: DataFrame, last: int = CONTEXT_TURNS, span: int = 10_000) -> DataFrame:
    """For every turn the ``last`` turns before it, of which those by user and assistant are kept.

    Long dialogues are cut into stretches of ``span`` turns; the last turns of a stretch also go
    to the next one as its context, so no task holds a whole dialogue.
    """
    placed = group_positions(turns, ["conv_id"], "turn", span)
    stretch = F.floor(F.col("position") / span)
    carried = F.when(F.col("position") % span >= span - last, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))
    spread = placed.withColumn("_own", stretch).withColumn("_stretch", F.explode(carried))
    before = Window.partitionBy("conv_id", "_stretch").orderBy("position").rowsBetween(-last, -1)
    earlier = F.collect_list(F.struct("role", "text")).over(before)
    return (
        spread.withColumn("context", F.filter(earlier, lambda t: t["role"].isin(*SPOKEN)))
        .filter(F.col("_own") == F.col("_stretch"))
        .drop("_own", "_stretch", "position")
    )
