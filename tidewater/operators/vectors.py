"""Vectors: the novelty scores built on centroids, medians and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import l2, min_max, weighted, zero_if_odd
from ..sources.scratch import cut
from .neighbours import METRICS, distances, knn  # noqa: F401
from .orders import medians, numbered

def centroid(vectors: DataFrame) -> DataFrame:
    """One row: c, the mean of every dimension."""
    means = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def centroid_distance(vectors: DataFrame) -> DataFrame:
    """id, distance from the centroid; the centroid's size is the number of dimensions."""
    return vectors.crossJoin(F.broadcast(centroid(vectors))).select("id", F.round(l2(F.col("v"), F.col("c")), 6).alias("distance"))


def neighbour_distance(vectors: DataFrame) -> DataFrame:
    """id, neighbour_id, distance of the nearest other vector; null and 0 where there is none.

    Searched once: scores read the few numbers of a row several times.
    """
    near = knn(vectors, vectors, 1, exclude_self=True).select(F.col("query_id").alias("id"), F.col("id").alias("neighbour_id"), "distance")
    return cut(vectors.select("id").join(near, "id", "left").select("id", "neighbour_id", F.coalesce("distance", F.lit(0.0)).alias("distance")), "nearest")


def robust_z(vectors: DataFrame) -> DataFrame:
    """id, distance: L2 of (x - median) / (1.4826 MAD); dimensions with a vanishing MAD add 0."""
    x = vectors.select("id", F.posexplode("v").alias("i", "x"))
    med = medians(x, "i", "x").withColumnRenamed("median", "m")
    away = x.join(F.broadcast(med), "i").select("i", F.abs(F.col("x") - F.col("m")).alias("a"))  # a row for each dimension
    mad = med.join(medians(away, "i", "a").withColumnRenamed("median", "d"), "i")
    both = mad.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.when(F.col("d") > 1e-12, 1.4826 * F.col("d")).alias("s")))).alias("r"))
    z = F.zip_with("v", "r", lambda x, r: F.coalesce((x - r["m"]) / r["s"], F.lit(0.0)))
    return vectors.crossJoin(F.broadcast(both)).select("id", F.round(F.sqrt(F.aggregate(z, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("distance"))


def normalised(scored: DataFrame, column: str, name: str, places: int = 6) -> DataFrame:
    ends = scored.agg(F.min(zero_if_odd(F.col(column))).alias("_lo"), F.max(zero_if_odd(F.col(column))).alias("_hi"))
    return scored.crossJoin(F.broadcast(ends)).withColumn(name, F.round(min_max(zero_if_odd(F.col(column)), F.col("_lo"), F.col("_hi")), places)).drop("_lo", "_hi")


def novelty(vectors: DataFrame, strategy: str = "hybrid", global_weight: float = 0.5, neighbour_weight: float = 0.5) -> DataFrame:
    """id, score by a named strategy; unknown names raise with the list of names."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown scoring strategy {strategy!r}; known: {', '.join(sorted(STRATEGIES))}")
    return STRATEGIES[strategy](vectors, global_weight, neighbour_weight)


def _global(v, *_):
    return centroid_distance(v).select("id", F.col("distance").alias("score"))


def _neighbour(v, *_):
    near = neighbour_distance(v)
    # without any neighbour the distance from the centroid stands in
    if not near.where("neighbour_id is not null").limit(1).count():
        return _global(v)
    return normalised(near, "distance", "score").select("id", "score")


def _hybrid(v, wg, wn):
    near = neighbour_distance(v)
    if not near.where("neighbour_id is not null").limit(1).count():
        return _global(v)
    g, n = normalised(cut(centroid_distance(v), "centroid"), "distance", "g", 12), normalised(near, "distance", "n", 12)
    return g.select("id", "g").join(n.select("id", "n"), "id").select("id", F.round(weighted([(wg, F.col("g")), (wn, F.col("n"))]), 6).alias("score"))


STRATEGIES = {
    "global_distance": _global,
    "centroid_distance": _global,
    "distance_to_center": _global,
    "memory_neighbor_distance": _neighbour,
    "nearest_neighbor_distance": lambda v, *_: neighbour_distance(v).select("id", F.col("distance").alias("score")),
    "hybrid": _hybrid,
    "robust_z_score": lambda v, *_: robust_z(v).select("id", F.col("distance").alias("score")),
}


def candidates(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best by (-score, id) with their rank; anomaly ids number all rows by id, not by rank."""
    out = numbered(scored, "id", "n").orderBy(F.desc("score"), "id").limit(k)
    out = out.withColumn("anomaly_id", F.format_string("anomaly-%04d", "n")).drop("n")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
