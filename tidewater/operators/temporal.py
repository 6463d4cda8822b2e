"""Change over time: observations of a sequence compared with the one before or with the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import change_id, l2

STRATEGIES = ("adjacent_difference", "baseline_difference")


def change_events(obs: DataFrame, strategy: str = "adjacent_difference", k: int | None = None) -> DataFrame:
    """sequence, source_id, target_id, distance, event_id, rank from (sequence, order_key, id, v).

    The distance is that of the vectors divided by the root of their length. Events are ranked in each sequence.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    order = Window.partitionBy("sequence").orderBy("order_key", "id")
    if strategy == "adjacent_difference":
        before = F.lag(F.struct("id", "v")).over(order)
    else:
        before = F.when(F.row_number().over(order) > 1, F.first(F.struct("id", "v")).over(order))
    pairs = obs.withColumn("s", before).where("s is not null")
    distance = F.round(l2(F.col("s.v"), F.col("v")) / F.sqrt(F.size("v")), 6)
    events = pairs.select("sequence", F.col("s.id").alias("source_id"), F.col("id").alias("target_id"), distance.alias("distance"))
    events = events.withColumn("event_id", change_id(F.col("sequence"), F.lit(strategy), F.col("source_id"), F.col("target_id")))
    events = events.withColumn("rank", F.row_number().over(Window.partitionBy("sequence").orderBy(F.desc("distance"), "event_id")))
    return events if k is None else events.where(F.col("rank") <= k)


def patch_evidence(left: DataFrame, right: DataFrame, pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k patches of each (source_id, target_id) that changed most; patches meet at equal (x, y, w, h)."""
    at = ["x", "y", "w", "h"]
    l = left.select(F.col("id").alias("source_id"), *at, F.col("v").alias("a"))  # noqa: E741
    r = right.select(F.col("id").alias("target_id"), *at, F.col("v").alias("b"))
    both = pairs.select("source_id", "target_id").join(l, "source_id").join(r, ["target_id", *at])
    scored = both.select("source_id", "target_id", *at, F.round(l2(F.col("a"), F.col("b")) / F.sqrt(F.size("a")), 6).alias("score"))
    w = Window.partitionBy("source_id", "target_id").orderBy(F.desc("score"), "y", "x")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def summary(events: DataFrame, adjacent: DataFrame) -> DataFrame:
    """sequence, max_distance, mean_adjacent, strongest target: ties go to the larger target."""
    best = events.groupBy("sequence").agg(F.max("distance").alias("max_distance"), F.max_by("target_id", F.struct("distance", "target_id")).alias("strongest_target"), F.count("*").alias("events"))
    return best.join(adjacent.groupBy("sequence").agg(F.round(F.avg("distance"), 6).alias("mean_adjacent")), "sequence")
