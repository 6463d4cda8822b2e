"""Tabular discovery: features, distance from the centre, deviations, reasons and groups.

Features stay named columns until the distance. Means and scales are one small row, the frequencies of all categorical
columns one table; they are computed in two passes and determine the centre, so a third pass gives the scores.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, is_missing, to_float
from ..sources.scratch import cut
from .profiling import _dtypes


def statistics(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[dict, DataFrame]:
    """(counts, means and deviations by column, in one small row; (c, value, n) how often each value of the c-th
    categorical column is there): two passes over the data, whatever the number of columns."""
    kinds = _dtypes(df)
    x = {c: F.when(~is_missing(F.col(c)), to_float(F.col(c), kinds[c])) for c in numeric}
    aggs = [a for i, c in enumerate(numeric) for a in (F.avg(x[c]).alias(f"mean{i}"), F.stddev_pop(x[c]).alias(f"scale{i}"), F.count(x[c]).alias(f"there{i}"))]
    one = df.agg(F.count("*").alias("n"), *aggs).first().asDict()
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.when(~is_missing(F.col(c)), F.col(c).cast("string")).alias("value")) for i, c in enumerate(categorical)])
    if not categorical:
        return one, df.sparkSession.createDataFrame([], "c int, value string, n long")
    told = df.select(F.explode(cells).alias("p")).select("p.*").where("value is not null").groupBy("c", "value").agg(F.count("*").alias("n"))
    return one, cut(told, "frequencies")


def featured(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str], list[float]]:
    """tabular_features() and the mean of each feature, which the statistics determine: no pass over the features."""
    kinds = _dtypes(df)
    one, told = statistics(df, numeric, categorical)
    n, out, names, means, lost = one["n"] or 0, df, [], [], 0.0
    for i, c in enumerate(numeric):
        x = F.when(~is_missing(F.col(c)), to_float(F.col(c), kinds[c]))
        scale = one[f"scale{i}"] if (one[f"scale{i}"] or 0) > 1e-12 else 1.0
        out = out.withColumn(f"{c}:z", F.coalesce((x - F.lit(one[f"mean{i}"])) / F.lit(scale), F.lit(0.0))).withColumn(f"{c}:missing", x.isNull().cast("double"))
        names += [f"{c}:z", f"{c}:missing"]
        means += [0.0, 1 - one[f"there{i}"] / max(n, 1)]
        lost += means[-1]
    rare = {r.c: r for r in told.groupBy("c").agg(F.sum("n").alias("there"), F.sum(F.col("n") * (1 - F.col("n") / F.lit(max(n, 1)))).alias("rarity")).collect()}  # a row a column
    for i, c in enumerate(categorical):
        gone = is_missing(F.col(c))
        freq = told.where(F.col("c") == i).select(F.col("value").alias(f"_v_{c}"), F.col("n").alias(f"_f_{c}"))
        out = out.join(freq, F.when(~gone, F.col(c).cast("string")) == F.col(f"_v_{c}"), "left")
        out = out.withColumn(f"{c}:rarity", F.coalesce(1 - F.col(f"_f_{c}") / F.lit(n), F.lit(1.0))).withColumn(f"{c}:missing", gone.cast("double")).drop(f"_v_{c}", f"_f_{c}")
        names += [f"{c}:rarity", f"{c}:missing"]
        there = rare[i].there if i in rare else 0
        means += [((rare[i].rarity if i in rare else 0.0) + n - there) / max(n, 1), 1 - there / max(n, 1)]
        lost += means[-1]
    cells = [F.col(f"`{c}:missing`") for c in (*numeric, *categorical)]
    out = out.withColumn("_missing", reduce(lambda a, b: a + b, cells, F.lit(0.0)))
    out = out.withColumn("completeness", 1 - F.col("_missing") / F.lit(float(len(cells))) if cells else F.lit(0.0))
    return out, [*names, "completeness"], [*means, 1 - lost / len(cells) if cells else 0.0]


def tabular_features(df: DataFrame, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, list[str]]:
    """df with a feature column for each name returned, and `_missing`, the number of missing cells.

    Numbers give a z score and a missing flag, categories one less their share of all rows and a flag; last comes the
    share of cells that are there.
    """
    return featured(df, numeric, categorical)[:2]


def centre(df: DataFrame, names: list[str]) -> list[float]:
    """Column means, in a small action."""
    return [m or 0.0 for m in df.agg(*[F.avg(F.col(f"`{c}`")) for c in names]).first()]


def with_distance(df: DataFrame, names: list[str], means: list[float] | None = None, places: int = 6) -> DataFrame:
    """df with score (L2 distance from the means, rounded) and deviations (feature, deviation), largest first. Means that
    are not given are measured."""
    d = [F.col(f"`{c}`") - F.lit(m) for c, m in zip(names, centre(df, names) if means is None else means)]
    score = F.round(F.sqrt(reduce(lambda a, b: a + b, [x * x for x in d])), places)
    devs = F.array(*[F.struct((-F.abs(F.round(x, places))).alias("o"), F.lit(i).alias("i"), F.lit(c).alias("feature"), F.round(x, places).alias("deviation")) for i, (c, x) in enumerate(zip(names, d))])
    ordered = F.transform(F.array_sort(devs), lambda s: F.struct(s["feature"].alias("feature"), s["deviation"].alias("deviation")))
    return df.withColumn("score", score).withColumn("deviations", ordered)


def reason() -> Column:
    """missing_values, categorical_rarity if one of the two largest deviations is a rarity, or numeric_deviation."""
    rare = F.exists(F.slice("deviations", 1, 2), lambda d: d["feature"].endswith(":rarity"))
    return F.when(F.col("_missing") > 0, "missing_values").when(rare, "categorical_rarity").otherwise("numeric_deviation")


def top(df: DataFrame, k: int | None, *tie: str) -> DataFrame:
    """The k rows of highest score with their rank. Only k rows are ranked: no task sees the whole order."""
    order = [F.desc("score"), *tie]
    best = df.orderBy(*order).limit(k) if k is not None else df
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def tabular_novelty(df: DataFrame, key: str, numeric: list[str], categorical: list[str], k: int | None = 10) -> DataFrame:
    """The most unusual rows: key, rank, score, reason, completeness and deviations."""
    scored = with_distance(*featured(df, numeric, categorical))
    return top(scored.select(key, "score", reason().alias("reason"), "completeness", "deviations"), k, key)


def group_confidence(score: str = "score") -> Column:
    """From the mean, number and spread of a group's scores."""
    n = F.least(F.lit(1.0), F.count("*") / 5)
    return clamp(0.4 * F.least(F.lit(1.0), F.avg(score)) + 0.3 * n + 0.3 / (1 + F.stddev_pop(score)))


def reason_groups(ranked: DataFrame, limit: int = 5, prefix: str = "concept") -> DataFrame:
    """Groups by reason in the order of first appearance: concept_id, reason, size, mean_score, confidence."""
    g = ranked.groupBy("reason").agg(F.min("rank").alias("first"), F.count("*").alias("size"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(group_confidence(), 6).alias("confidence"))
    g = g.withColumn("n", F.row_number().over(Window.orderBy("first"))).where(F.col("n") <= limit)
    return g.select(F.format_string(f"{prefix}-%04d", "n").alias("concept_id"), "reason", "size", "mean_score", "confidence")


def concept_summary() -> Column:
    """One sentence about a reason group."""
    what = F.when(F.col("reason") == "missing_values", "missing values").when(F.col("reason") == "categorical_rarity", "rare categories").when(F.col("reason") == "numeric_deviation", "numbers far from the mean").otherwise(F.regexp_replace("reason", "_", " "))
    return F.concat(F.col("size").cast("string"), F.when(F.col("size") == 1, " row with ").otherwise(" rows with "), what)
