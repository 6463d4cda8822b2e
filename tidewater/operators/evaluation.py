"""Calibration of scores, thresholds and labelled evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import min_max
from .orders import order_statistics, running


def calibrate(fit: DataFrame, scores: DataFrame, method: str = "empirical_percentile", clip: bool = True) -> DataFrame:
    """scores (id, score) with `calibrated`: identity, the share of fitted scores at or below, or min-max."""
    if method == "identity":
        return scores.withColumn("calibrated", F.col("score"))
    if method == "minmax":
        ends = fit.agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
        raw = (F.col("score") - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
        value = min_max(F.col("score"), F.col("_lo"), F.col("_hi")) if clip else F.coalesce(raw, F.lit(0.0))
        return scores.crossJoin(F.broadcast(ends)).withColumn("calibrated", F.round(value, 6)).drop("_lo", "_hi")
    if method != "empirical_percentile":
        raise ValueError("method must be identity, minmax or empirical_percentile")
    return empirical_percentile(fit, scores)


def empirical_percentile(fit: DataFrame, scores: DataFrame) -> DataFrame:
    """Right-inclusive empirical distribution of the fitted scores at each score; equal scores are counted first."""
    counts = fit.groupBy("score").agg(F.count("*").alias("k")).union(scores.select("score", F.lit(0).cast("long").alias("k"))).groupBy("score").agg(F.sum("k").alias("k"))
    cdf = running(counts, "score", ["k"]).select(F.col("score").alias("_s"), F.round((F.col("k_before") + F.col("k")) / F.col("k_total"), 6).alias("calibrated"))
    return scores.join(cdf, F.col("score") == F.col("_s")).drop("_s")


def threshold_candidates(scores: DataFrame, explicit: dict[str, float] | None = None, percentiles: tuple[float, ...] = (), fractions: tuple[float, ...] = ()) -> DataFrame:
    """threshold_id, threshold: given values, exact percentiles, and the score at rank ceil(n * fraction)."""
    spark = scores.sparkSession
    places = {f"percentile-{p:g}": (lambda n, p=p: (n - 1) * F.lit(p / 100)) for p in percentiles}
    # rank r from the top is place n - r from the bottom
    places |= {f"top_fraction-{f:g}": (lambda n, f=f: F.greatest(n - F.greatest(F.ceil(n * F.lit(f)), F.lit(1)), F.lit(0))) for f in fractions}
    row = order_statistics(scores, "score", places) if places else {}
    found = {**{f"explicit-{k}": v for k, v in (explicit or {}).items()}, **{k: v for k, v in row.items() if v is not None}}
    return spark.createDataFrame(sorted((k, float(v)) for k, v in found.items()), "threshold_id string, threshold double")


def confusion(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Counts and rates for each threshold over (score, label 0/1); one label missing makes all supervised values null."""
    t = F.broadcast(thresholds)  # a few rows that the caller named
    hit, pos = F.col("score") >= F.col("threshold"), F.col("label") == 1
    n = lambda c: F.sum(c.cast("long"))
    both = scored.crossJoin(t).groupBy("threshold_id", "threshold").agg(
        n(hit).alias("selected"), n(hit & pos).alias("tp"), n(hit & ~pos).alias("fp"), n(~hit & ~pos).alias("tn"), n(~hit & pos).alias("fn"), n(F.col("label").isNull()).alias("unlabelled")
    )
    ok = F.col("unlabelled") == 0
    p = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    r = F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f1 = 2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    cols = [F.when(ok, F.col(c)).alias(c) for c in ("tp", "fp", "tn", "fn")]
    return both.select("threshold_id", "threshold", "selected", *cols, *[F.round(F.when(ok, c), 6).alias(k) for k, c in (("precision", p), ("recall", r), ("f1", f1))])


def _ranked(scored: DataFrame) -> DataFrame:
    """Positives and negatives of each distinct score with their counts above."""
    g = scored.where("label is not null").groupBy("score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.count("*").alias("n"))
    above = running(g, "score", ["pos", "n"], descending=True)
    return above.select("score", "pos", (F.col("n") - F.col("pos")).alias("neg"), F.col("pos_before").alias("pos_above"), F.col("n_before").alias("above"), "n")


def auroc(scored: DataFrame) -> DataFrame:
    """auroc: the share of (positive, negative) pairs in the right order, ties a half; null without either."""
    r = _ranked(scored)
    won = F.sum(F.col("neg") * F.col("pos_above") + 0.5 * F.col("neg") * F.col("pos"))
    return r.agg(F.round(won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)), 6).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    r = _ranked(scored)
    part = F.col("pos") * (F.col("pos_above") + F.col("pos")) / (F.col("above") + F.col("n"))
    return r.agg(F.round(F.sum(part) / F.nullif(F.sum("pos"), F.lit(0)), 6).alias("average_precision"))


def at_k(scored: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """k, precision, recall of the k best by (-score, id); rows without label are left out."""
    known = scored.where("label is not null")
    total = known.agg(F.sum(F.col("label").cast("long")).alias("p")).first().p or 0
    best = known.orderBy(F.desc("score"), "id").limit(max(ks)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    k = F.explode(F.array(*[F.lit(x) for x in ks]))
    g = best.select("r", "label", k.alias("k")).where(F.col("r") <= F.col("k")).groupBy("k").agg(F.sum(F.col("label").cast("long")).alias("hit"), F.count("*").alias("n"))
    return g.select("k", F.round(F.col("hit") / F.col("n"), 6).alias("precision"), F.round(F.col("hit") / F.lit(total or None).cast("double"), 6).alias("recall"))


def operating_points(scored: DataFrame, explicit: float, percentile: float, top_k: int, top_fraction: float) -> DataFrame:
    """strategy, threshold, selected: a given threshold, a percentile, exactly k, and a fraction with its ties."""
    n = scored.count()
    c = threshold_candidates(scored, {"x": explicit}, (percentile,), (top_fraction,))
    counted = scored.crossJoin(F.broadcast(c)).where("score >= threshold").groupBy("threshold_id").agg(F.count("*").alias("selected"))
    points = c.join(counted, "threshold_id", "left").select(F.regexp_replace("threshold_id", "-.*", "").alias("strategy"), F.round("threshold", 6).alias("threshold"), F.coalesce("selected", F.lit(0)).alias("selected"))
    kth = scored.orderBy(F.desc("score"), "id").limit(top_k).agg(F.lit("top_k").alias("strategy"), F.round(F.min("score"), 6).alias("threshold"), F.lit(min(top_k, n)).cast("long").alias("selected"))
    return points.union(kth)


def missing_predictions(samples: DataFrame, predictions: DataFrame) -> DataFrame:
    return samples.join(predictions, "id", "left_anti").select("id")


def acceptance(metrics: DataFrame, least: dict[str, float], most: dict[str, float]) -> DataFrame:
    """gate, value, bound, passed for a one-row table of metrics; a metric that is not there fails."""
    gates = [(k, v, True) for k, v in least.items()] + [(k, v, False) for k, v in most.items()]
    value: dict[str, Column] = {k: F.col(k).cast("double") if k in metrics.columns else F.lit(None).cast("double") for k, _, _ in gates}
    rows = [F.struct(F.lit(f"{'min' if up else 'max'}_{k}").alias("gate"), value[k].alias("value"), F.lit(float(b)).alias("bound"), F.coalesce(value[k] >= b if up else value[k] <= b, F.lit(False)).alias("passed")) for k, b, up in gates]
    return metrics.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def calibration_result(fit: DataFrame, scored: DataFrame, method: str, explicit: dict[str, float] | None = None, percentiles: tuple[float, ...] = (), fractions: tuple[float, ...] = (), clip: bool = True) -> DataFrame:
    """confusion() of scored (id, score, label 0/1) after calibration by `fit`, at thresholds chosen among the calibrated
    scores; with the strategy of each threshold, the share selected, the method, and whether it changes scores at all."""
    calibrated = calibrate(fit.select("score"), scored.select("id", "score", "label"), method, clip).select("id", F.col("calibrated").alias("score"), "label")
    points = confusion(calibrated, threshold_candidates(calibrated, explicit, percentiles, fractions))
    total = calibrated.agg(F.count("*").alias("_n"))
    share = F.round(F.col("selected") / F.nullif(F.col("_n"), F.lit(0)), 6)
    both = points.crossJoin(F.broadcast(total))  # one row
    return both.select(*points.columns, F.regexp_replace("threshold_id", "-.*", "").alias("strategy"), share.alias("selected_fraction"), F.lit(method).alias("method"), F.lit(method != "identity").alias("calibrated"))


def metric_summary(rows: DataFrame) -> DataFrame:
    """One row about samples (id, label 0, 1 or null, score or null, selected): counts, range, AUROC, average precision
    and warnings parted by commas. Without scored samples of both labels the supervised values are null."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    scored, label = F.col("score").isNotNull(), F.col("label")
    counts = rows.agg(
        F.count("*").alias("samples"), F.count("score").alias("scored"), F.count("label").alias("labelled"), n(label == 0).alias("normal"), n(label == 1).alias("anomalies"), n(label.isNull()).alias("unknown"),
        n(scored & F.col("selected")).alias("selected"), F.min("score").alias("low"), F.max("score").alias("high"), n(scored & (label == 1)).alias("_positive"), n(scored & (label == 0)).alias("_negative"),
    )
    judged = rows.where(scored & label.isNotNull()).select("id", "score", "label")
    both = counts.crossJoin(auroc(judged)).crossJoin(average_precision(judged))  # one row each
    warned = {"missing_predictions": F.col("scored") < F.col("samples"), "no_positive_labels": F.col("_positive") == 0, "no_negative_labels": F.col("_negative") == 0, "equal_scores": F.col("low") == F.col("high")}
    names = ("samples", "scored", "labelled", "normal", "anomalies", "unknown", "selected")
    fraction = F.round(F.coalesce(F.col("selected") / F.nullif(F.col("scored"), F.lit(0)), F.lit(0.0)), 6)
    supervised = (F.col("_positive") > 0) & (F.col("_negative") > 0)
    return both.select(
        *names, fraction.alias("selected_fraction"), "low", "high", F.when(supervised, F.col("auroc")).alias("auroc"), F.when(F.col("_positive") > 0, F.col("average_precision")).alias("average_precision"),
        F.concat_ws(",", *[F.when(c, F.lit(k)) for k, c in warned.items()]).alias("warnings"),
    )
