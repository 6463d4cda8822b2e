"""Acceptance policies of labelled evaluations: which operating points they ask for, and whether they are met."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from .evaluation import confusion, metric_summary, missing_predictions, threshold_candidates

# Ways to choose an operating point, and what a policy and each of its points may hold.
STRATEGIES = ("explicit", "percentile", "top_k", "top_fraction")
POLICY = ("dataset_name", "dataset_version", "split_name", "min_auroc", "min_average_precision", "max_missing_predictions", "operating_points")
POINT = ("strategy", "value", "min_precision", "min_recall", "max_selected_fraction")


def run_config(policy: dict) -> dict:
    """The split and, for each strategy, the values whose operating points the policy needs."""
    for name in POLICY[:3]:
        if not isinstance(policy.get(name), str) or not policy[name].strip():
            raise ConfigurationError(f"{name} must be a name", context={"field": name})
    if unknown := set(policy) - set(POLICY):
        raise ConfigurationError(f"unknown fields of a policy: {sorted(unknown)}")
    for bound in ("min_auroc", "min_average_precision"):
        if policy.get(bound) is not None and not 0 <= policy[bound] <= 1:
            raise ConfigurationError(f"{bound} must lie between 0 and 1")
    points = policy.get("operating_points", [])
    seen = set()
    for p in points:
        if set(p) - set(POINT) or p.get("strategy") not in STRATEGIES or not isinstance(p.get("value"), (int, float)) or isinstance(p["value"], bool):
            raise ConfigurationError("an operating point needs a strategy and a value", context={"point": p})
        key, v = (p["strategy"], float(p["value"])), p["value"]
        if key in seen:
            raise ConfigurationError(f"{key[0]} {v:g} is named twice")
        if (key[0] == "percentile" and not 0 <= v <= 100) or (key[0] == "top_fraction" and not 0 < v <= 1) or (key[0] == "top_k" and (v < 1 or v != int(v))):
            raise ConfigurationError(f"{key[0]} {v:g} is out of range")
        seen.add(key)
    of = lambda s: [int(p["value"]) if s == "top_k" else float(p["value"]) for p in points if p["strategy"] == s]
    return {"split_name": policy["split_name"], **{s: of(s) for s in STRATEGIES}}


def operating_points(scored: DataFrame, config: dict) -> DataFrame:
    """strategy, value, threshold, selected, selected_fraction, precision, recall over (id, score, label 0 or 1).

    A threshold selects all that reach it; top_k selects exactly the k best by (-score, id).
    """
    n = scored.agg(F.count("*").alias("_n"), F.sum(F.col("label").cast("long")).alias("_p"))  # one row
    share = F.round(F.col("selected") / F.nullif(F.col("_n"), F.lit(0)), 6).alias("selected_fraction")
    names = {f"explicit-v{i}": ("explicit", v) for i, v in enumerate(config["explicit"])}
    names |= {f"percentile-{v:g}": ("percentile", v) for v in config["percentile"]} | {f"top_fraction-{v:g}": ("top_fraction", v) for v in config["top_fraction"]}
    out = []
    if names:
        named = scored.sparkSession.createDataFrame([(k, s, float(v)) for k, (s, v) in names.items()], "threshold_id string, strategy string, value double")
        found = threshold_candidates(scored, {f"v{i}": v for i, v in enumerate(config["explicit"])}, tuple(config["percentile"]), tuple(config["top_fraction"]))
        counts = confusion(scored, found).join(F.broadcast(named), "threshold_id").crossJoin(F.broadcast(n))
        out.append(counts.select("strategy", "value", F.round("threshold", 6).alias("threshold"), "selected", share, "precision", "recall"))
    for k in config["top_k"]:
        best = scored.orderBy(F.desc("score"), "id").limit(k).agg(F.min("score").alias("t"), F.count("*").alias("selected"), F.sum(F.col("label").cast("long")).alias("hit"))
        ratio = lambda under: F.round(F.col("hit") / F.nullif(F.col(under), F.lit(0)), 6)
        out.append(best.crossJoin(F.broadcast(n)).select(F.lit("top_k").alias("strategy"), F.lit(float(k)).alias("value"), F.round("t", 6).alias("threshold"), "selected", share, ratio("selected").alias("precision"), ratio("_p").alias("recall")))
    if not out:
        return scored.sparkSession.createDataFrame([], "strategy string, value double, threshold double, selected long, selected_fraction double, precision double, recall double")
    return reduce(DataFrame.union, out)


def accept(samples: DataFrame, scored: DataFrame, policy: dict) -> DataFrame:
    """check, value, bound, passed for every requirement of a policy.

    samples holds id and label (0, 1 or null) of the split, scored id and score. A value that is not available fails.
    """
    config = run_config(policy)
    rows = samples.join(scored.select("id", "score"), "id", "left").withColumn("selected", F.lit(False))
    known = rows.where("score is not null and label is not null").select("id", "score", "label")
    checks = []

    def check(df: DataFrame, name, value: str, bound: float, least: bool) -> None:
        v = F.col(value).cast("double")
        checks.append(df.select(F.lit(name).alias("check"), v.alias("value"), F.lit(float(bound)).alias("bound"), F.coalesce(v >= bound if least else v <= bound, F.lit(False)).alias("passed")))

    metrics = metric_summary(rows)
    for name in ("auroc", "average_precision"):
        if policy.get(f"min_{name}") is not None:
            check(metrics, f"min_{name}", name, policy[f"min_{name}"], True)
    lost = missing_predictions(samples, scored).agg(F.count("*").alias("missing"))
    check(lost, "max_missing_predictions", "missing", policy.get("max_missing_predictions", 0), False)
    points = operating_points(known, config)
    for p in policy.get("operating_points", []):
        own = points.where((F.col("strategy") == p["strategy"]) & (F.col("value") == float(p["value"])))
        label = f"{p['strategy']}={p['value']:g}"
        for bound, column, least in (("min_precision", "precision", True), ("min_recall", "recall", True), ("max_selected_fraction", "selected_fraction", False)):
            if p.get(bound) is not None:
                check(own, f"{bound} at {label}", column, p[bound], least)
    return reduce(DataFrame.union, checks)
