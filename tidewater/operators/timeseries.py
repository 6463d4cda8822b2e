"""Time-series discovery: features of each point from its entity's past, distance from the centre, reasons."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, to_float
from ..sources.scratch import cut
from .orders import range_of, running
from .profiling import _dtypes, baseline_gap
from .tabular import top, with_distance

SPIKE = 2.0


def signal_values(df: DataFrame, signals: list[str]) -> dict[str, Column]:
    kinds = _dtypes(df)
    return {s: F.when(~is_missing(F.col(s)), to_float(F.col(s), kinds[s])) for s in signals}


def in_blocks(rows: DataFrame, ts: str, key: str, before: int, block: int) -> DataFrame:
    """rows with `_block`, stretches of `block` rows in the order of (ts, key), each led by the `before` rows before it,
    which `_lead` marks. Times are counted and summed by ranges; only rows of one time are ordered together."""
    block = max(block, before + 1)
    timed = rows.withColumn("_at", F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{ts}` as timestamp_ntz))"))
    earlier = running(timed.groupBy("_at").agg(F.count("*").alias("_n")), "_at", ["_n"]).select("_at", "_n_before")
    place = F.col("_n_before") + F.row_number().over(Window.partitionBy("_at").orderBy(key)) - 1
    placed = timed.join(earlier, "_at").withColumn("_place", place).withColumn("_home", F.floor(F.col("_place") / block))
    ends = F.col("_place") % block >= block - before
    dealt = placed.withColumn("_block", F.explode(F.when(ends, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))))
    return dealt.withColumn("_lead", F.col("_block") != F.col("_home")).drop("_at", "_n_before", "_place", "_home")


def of_entities(rows: DataFrame, ts: str, entity: str, key: str, before: int, block: int, most_ranges: int = 4096) -> DataFrame:
    """rows with `_block` and `_lead`: entities of more than `block` rows are cut into ranges of their own time, each led by
    the `before` rows of the entity before it; all others are one block.

    The ranges' last rows, `before` of each, are numbered through an entity; a range takes the highest numbers before it.
    """
    counts = cut(rows.groupBy(F.col(entity).alias("_who")).agg(F.count("*").alias("_n")).where(F.col("_n") > block), "busy")
    most = counts.agg(F.max("_n")).first()[0]
    if most is None:
        return rows.withColumn("_block", F.lit(0)).withColumn("_lead", F.lit(False))
    n = min(max(2, -(-most // block)), most_ranges)
    own = F.col(entity).eqNullSafe(F.col("_who"))
    timed = rows.withColumn("_at", F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(`{ts}` as timestamp_ntz))"))
    edges = timed.join(counts, own, "left_semi").groupBy(F.col(entity).alias("_who")).agg(F.percentile_approx("_at", [i / n for i in range(1, n)], 10 * n).alias("_e"))
    # at most as many busy entities as blocks of rows; beyond a checked number Spark joins them by key
    edges = cut(edges.select("_who", "_e", F.filter("_e", lambda x, i: (i + 1) % isqrt(n) == 0).alias("_c")), "busy-ranges")
    few = counts.limit(10_001).count() <= 10_000
    placed = timed.join(F.broadcast(edges) if few else edges, own, "left").withColumn("_block", F.coalesce(range_of("_at", n), F.lit(0)).cast("int"))
    placed = placed.withColumn("_busy", F.col("_e").isNotNull()).drop("_who", "_e", "_c", "_at")
    late = Window.partitionBy(entity, "_block").orderBy(F.desc(ts), F.desc(key))
    tails = placed.where("_busy").withColumn("_k", F.row_number().over(late)).where(F.col("_k") <= before).drop("_k")
    tails = cut(tails.withColumn("_p", F.row_number().over(Window.partitionBy(entity).orderBy("_block", ts, key))), "tails")
    past = Window.partitionBy("_who").orderBy("_to").rowsBetween(Window.unboundedPreceding, -1)
    places = tails.groupBy(F.col(entity).alias("_who"), F.col("_block").alias("_to")).agg(F.count("*").alias("_n")).select("_who", "_to", F.sum("_n").over(past).alias("_past")).where("_past > 0")
    wanted = places.select("_who", "_to", F.explode(F.sequence(F.greatest(F.col("_past") - before + 1, F.lit(1).cast("long")), F.col("_past"))).alias("_q"))
    leads = tails.join(wanted, own & (F.col("_p") == F.col("_q"))).withColumn("_block", F.col("_to"))
    return placed.select(*rows.columns, "_block", F.lit(False).alias("_lead")).union(leads.select(*rows.columns, "_block", F.lit(True).alias("_lead")))


def timeseries_features(df: DataFrame, ts: str, entity: str | None, signals: list[str], key: str, window: int = 3, gap: float | None = None, block: int = 1_000_000) -> tuple[DataFrame, list[str]]:
    """df's rows with a valid time, a column for each feature named, `_gap`, `_spikes` and `_missing`.

    For each signal: z, missing, change and its size in units of the signal's scale, distance from and spread of the
    rolling mean, spike; then a flag for a gap longer than the baseline, and the share of signals that are there.
    Without an entity the rows are one series. It is cut into blocks of rows that overlap by what a feature looks back, as
    are entities of more than `block` rows.
    """
    gap = baseline_gap(df, ts) if gap is None else gap
    x = signal_values(df, signals)
    rows = df.where(F.col(ts).isNotNull()).select("*", *[x[s].alias(f"_x{i}") for i, s in enumerate(signals)])
    stats = rows.agg(*[a for i in range(len(signals)) for a in (F.avg(f"_x{i}").alias(f"_a{i}"), F.stddev_pop(f"_x{i}").alias(f"_s{i}"))])
    rows = rows.crossJoin(F.broadcast(stats))  # one row
    back = max(window - 1, 1)
    rows = of_entities(rows, ts, entity, key, back, block) if entity else in_blocks(rows, ts, key, back, block)
    order = Window.partitionBy(*([entity] if entity else []), "_block").orderBy(ts, key)
    last = order.rowsBetween(-(window - 1), 0)
    names: list[str] = []
    spikes = F.lit(0.0)
    for i, s in enumerate(signals):
        v, scale = F.col(f"_x{i}"), F.when(F.col(f"_s{i}") > 1e-12, F.col(f"_s{i}")).otherwise(1.0)
        delta = F.coalesce((v - F.lag(v).over(order)) / scale, F.lit(0.0))
        away = F.coalesce((v - F.avg(v).over(last)) / scale, F.lit(0.0))
        parts = {
            "z": F.coalesce((v - F.col(f"_a{i}")) / scale, F.lit(0.0)),
            "missing": v.isNull().cast("double"),
            "delta": delta,
            "abs_delta": F.abs(delta),
            "rolling_mean_delta": away,
            "rolling_std": F.coalesce(F.round(F.stddev_pop(v).over(last), 9) / scale, F.lit(0.0)),
        }
        rows = rows.select("*", *[c.alias(f"{s}:{n}") for n, c in parts.items()])
        rows = rows.withColumn(f"{s}:spike", ((F.col(f"`{s}:abs_delta`") > SPIKE) | (F.abs(F.col(f"`{s}:rolling_mean_delta`")) > SPIKE)).cast("double"))
        spikes = spikes + F.col(f"`{s}:spike`")
        names += [f"{s}:{n}" for n in (*parts, "spike")]
    seconds = F.coalesce(F.expr(f"timestampdiff(MICROSECOND, _before, `{ts}`)") / 1e6, F.lit(0.0))
    rows = rows.withColumn("_before", F.lag(ts).over(order)).withColumn("time_gap", ((seconds > gap) & F.lit(gap > 0)).cast("double"))
    missing = sum((F.col(f"`{s}:missing`") for s in signals), F.lit(0.0))
    rows = rows.withColumn("_spikes", spikes).withColumn("_missing", missing).withColumn("completeness", 1 - F.col("_missing") / F.lit(float(len(signals) or 1)))
    drop = [f"_{k}{i}" for i in range(len(signals)) for k in "xas"]
    rows = rows.where(~F.col("_lead")).drop("_block", "_lead")
    return rows.drop(*drop, "_before"), [*names, "time_gap", "completeness"]


def reason() -> Column:
    return F.when(F.col("time_gap") > 0, "time_gap").when(F.col("_spikes") > 0, "signal_change").when(F.col("_missing") > 0, "missing_signal").otherwise("feature_profile")


def timeseries_novelty(df: DataFrame, ts: str, entity: str | None, signals: list[str], key: str, k: int | None = 10, window: int = 3) -> DataFrame:
    """The most unusual points: key, time, rank, score, reason and deviations."""
    features, names = timeseries_features(df, ts, entity, signals, key, window)
    scored = with_distance(features, names).select(key, F.col(ts), *([entity] if entity else []), "score", reason().alias("reason"), "deviations")
    return top(scored, k, ts, key)
