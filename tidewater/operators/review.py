"""Human feedback: counts, rollups and the signal that reviews give to a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels that a review may give, the kinds of target, and the weights of the signal.
LABELS = ("interesting", "known_pattern", "false_positive", "duplicate", "important", "not_useful", "needs_more_data")
TARGETS = ("anomaly", "concept", "temporal")
WEIGHTS = {"interesting": 1.0, "important": 1.0, "false_positive": -1.0, "not_useful": -1.0, "needs_more_data": 0.25, "known_pattern": -0.25, "duplicate": -0.5}
SCHEMA = "feedback_id string, run_id string, report_path string, target_type string, target_id string, label string, notes string, reviewer string, created_at string, metadata map<string,string>"


def label_counts(feedback: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = feedback if run_id is None else feedback.where(F.col("run_id") == run_id)
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def rollup(feedback: DataFrame) -> DataFrame:
    """Counts by label, by (kind, label) and by (kind, target, label) in one pass; absent columns are null."""
    sets = [["label"], ["target_type", "label"], ["target_type", "target_id", "label"]]
    return feedback.groupingSets([[F.col(c) for c in s] for s in sets], "target_type", "target_id", "label").agg(F.count("*").alias("n"))


def signals(feedback: DataFrame) -> DataFrame:
    """target_type, target_id, reviews, delta."""
    weight = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    w = F.coalesce(F.try_element_at(weight, "label"), F.lit(0.0))
    return feedback.groupBy("target_type", "target_id").agg(F.count("*").alias("reviews"), F.round(F.sum(w), 6).alias("delta"))


def with_signal(targets: DataFrame, feedback: DataFrame) -> DataFrame:
    """targets (target_type, target_id, ...) with reviews and delta, 0 without any."""
    s = signals(feedback)
    return targets.join(s, ["target_type", "target_id"], "left").fillna(0, ["reviews"]).fillna(0.0, ["delta"])


def add_feedback(new: DataFrame, targets: DataFrame) -> DataFrame:
    """The new reviews of known labels and kinds whose target exists."""
    ok = F.col("label").isin(*LABELS) & F.col("target_type").isin(*TARGETS)
    return new.where(ok).join(targets, ["target_type", "target_id"], "left_semi")
