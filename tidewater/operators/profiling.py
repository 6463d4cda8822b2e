"""Profiles: one pass over the data for each, results of a row per column or a single row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_missing, to_float
from .orders import order_statistics, range_of, ranges

HIGH_CARDINALITY = 50


def _dtypes(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def tabular_profile(df: DataFrame, columns: list[str] | None = None, most_values: int = HIGH_CARDINALITY) -> DataFrame:
    """column, missing_count, non_missing_count, unique_count, detected_type, warning: one aggregation in all.

    A column is numeric if it has a value and every value is a finite number, else categorical; categorical ones of more
    than `most_values` values are warned of.
    """
    kinds = _dtypes(df)
    columns = columns or df.columns
    aggs = []
    for i, c in enumerate(columns):
        gone = is_missing(F.col(c))
        aggs += [
            F.sum(gone.cast("long")).alias(f"m{i}"),
            F.count_distinct(F.when(~gone, F.col(c).cast("string"))).alias(f"u{i}"),
            F.coalesce(F.bool_and(F.when(~gone, to_float(F.col(c), kinds[c]).isNotNull())), F.lit(False)).alias(f"n{i}"),
        ]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    part = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("missing_count"), F.col(f"u{i}").alias("unique_count"), F.col(f"n{i}").alias("numeric")) for i, c in enumerate(columns)]))
    out = one.select("rows", part.alias("p")).select("rows", "p.*")
    kind = F.when(F.col("numeric"), "numeric").otherwise("categorical")
    warning = F.when((kind == "categorical") & (F.col("unique_count") > most_values), "high_cardinality").otherwise("")
    return out.select("column", "missing_count", (F.col("rows") - F.col("missing_count")).alias("non_missing_count"), "unique_count", kind.alias("detected_type"), warning.alias("warning"))


def roles(df: DataFrame, columns: list[str] | None = None, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns; one small action, as the roles decide the next plan."""
    got = {r["column"]: r["detected_type"] for r in tabular_profile(df, columns).select("column", "detected_type").collect()}
    names = [c for c in columns or df.columns if c not in exclude]
    return [c for c in names if got[c] == "numeric"], [c for c in names if got[c] == "categorical"]


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, mean, scale: population deviation, 1 where it vanishes."""
    kinds = _dtypes(df)
    x = {c: F.when(~is_missing(F.col(c)), to_float(F.col(c), kinds[c])) for c in columns}
    one = df.agg(*[a for i, c in enumerate(columns) for a in (F.avg(x[c]).alias(f"a{i}"), F.stddev_pop(x[c]).alias(f"s{i}"))])
    part = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"a{i}"), F.lit(0.0)).alias("mean"), F.when(F.col(f"s{i}") > 1e-12, F.col(f"s{i}")).otherwise(1.0).alias("scale")) for i, c in enumerate(columns)]))
    return one.select(part.alias("p")).select("p.*")


def categorical_frequency(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, count of every value that is not missing."""
    part = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(~is_missing(F.col(c)), F.col(c).cast("string")).alias("value")) for c in columns]))
    return df.select(part.alias("p")).select("p.*").where("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))


def duplicate_keys(df: DataFrame, ts: str, entity: str | None) -> DataFrame:
    """duplicate_count: rows beyond the first of each (entity, time)."""
    key = [F.coalesce(F.col(entity).cast("string"), F.lit("")) if entity else F.lit(""), F.col(ts)]
    n = df.where(F.col(ts).isNotNull()).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_count"))


def gap_counts(df: DataFrame, ts: str) -> DataFrame:
    """(gap, n): seconds between neighbours in the order of time, and how often each row stands for such a gap.

    Equal times are counted before they are ordered, and times are ordered by ranges with their ends stitched, so neither
    a busy day nor a busy moment lands in one task.
    """
    kind = "timestamp_ntz" if _dtypes(df)[ts] == "timestamp_ntz" else "timestamp"
    at = F.expr(f"timestampdiff(MICROSECOND, {kind}'1970-01-01 00:00:00', `{ts}`)")
    t = df.where(F.col(ts).isNotNull()).groupBy(at.alias("at")).agg(F.count("*").alias("k"))
    parts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = t.crossJoin(F.broadcast(ranges(t, "at", parts))).select("at", range_of("at", parts).alias("b"))
    gap = lambda a, b: ((F.col(b) - F.col(a)) / 1e6).alias("gap")
    inside = ranged.withColumn("p", F.lag("at").over(Window.partitionBy("b").orderBy("at"))).where("p is not null").select(gap("p", "at"))
    ends = ranged.groupBy("b").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    across = ends.withColumn("p", F.lag("last").over(Window.orderBy("b"))).where("p is not null").select(gap("p", "first"))
    ties = t.agg(F.sum(F.col("k") - 1).alias("n")).where("n > 0").select(F.lit(0.0).alias("gap"), "n")
    return inside.union(across).withColumn("n", F.lit(1).cast("long")).union(ties)


def _upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def sampling_summary(df: DataFrame, ts: str) -> DataFrame:
    """gap_count, min_gap, median_gap (the upper one), max_gap, irregular."""
    gaps = gap_counts(df, ts)
    at = order_statistics(gaps, "gap", {"low": lambda n: F.lit(0), "middle": _upper_middle, "high": lambda n: n - 1}, "n")
    n = gaps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    row = (n, at["low"], at["middle"], at["high"], bool(n and at["high"] > at["low"]))
    return df.sparkSession.createDataFrame([row], "gap_count long, min_gap double, median_gap double, max_gap double, irregular boolean")


def baseline_gap(df: DataFrame, ts: str) -> float:
    """Upper median of the positive gaps, 0 without any."""
    return order_statistics(gap_counts(df, ts).where("gap > 0"), "gap", {"middle": _upper_middle}, "n")["middle"] or 0.0


def timeseries_profile(df: DataFrame, ts: str, signals: list[str], entity: str | None) -> DataFrame:
    """A single row: rows, valid rows, missing signal cells, the range of time, and entities."""
    kinds = _dtypes(df)
    valid = F.col(ts).isNotNull()
    missing = sum((is_missing(F.col(s)).cast("long") for s in signals), F.lit(0))
    numeric = [F.coalesce(F.bool_and(F.when(valid & ~is_missing(F.col(s)), to_float(F.col(s), kinds[s]).isNotNull())), F.lit(False)).cast("int") for s in signals]
    return df.agg(
        F.count("*").alias("row_count"),
        F.sum(valid.cast("long")).alias("valid_count"),
        F.sum(missing).cast("long").alias("missing_signal_count"),
        F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss").alias("first_time"),
        F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last_time"),
        F.count_distinct(entity).alias("entity_count") if entity else F.lit(0).cast("long").alias("entity_count"),
        sum(numeric, F.lit(0)).cast("long").alias("signal_count"),
    )


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    """One row: count, min, max, mean, population deviation and exact quartiles."""
    s = F.col(score)
    one = df.agg(F.count(s).alias("count"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))
    quartiles = {f"p{round(100 * p):02d}": (lambda n, p=p: (n - 1) * F.lit(p)) for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    return one.select("*", *[F.lit(v).cast("double").alias(k) for k, v in order_statistics(df, score, quartiles).items()])
