"""Scores against a stored set of ordinary vectors, and their maps over images."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from . import rasters
from .coreset import farthest_first  # noqa: F401
from .evaluation import metric_summary
from .neighbours import knn


def check_compatible(queries: DataFrame, reference: DataFrame) -> None:
    """Unique ids, one number of dimensions, and no vector in both roles; else ValueError."""
    for name, df in (("query", queries), ("reference", reference)):
        n, ids, low, high = df.agg(F.count("*"), F.count_distinct("id"), F.min(F.size("v")), F.max(F.size("v"))).first()
        if n != ids:
            raise ValueError(f"{name} ids are not unique")
        if low != high:
            raise ValueError(f"{name} vectors differ in length")
    if queries.select(F.size("v")).limit(1).collect() != reference.select(F.size("v")).limit(1).collect():
        raise ValueError("query and reference vectors differ in length")
    if queries.join(reference, "id", "left_semi").limit(1).count():
        raise ValueError("a vector is both query and reference")


def patch_scores(queries: DataFrame, reference: DataFrame, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """id, score: the distance of the nearest reference vector, or the mean of the k nearest."""
    near = knn(queries, reference, k, metric)
    scores = near.groupBy(F.col("query_id").alias("id")).agg(F.round(F.avg("distance"), 6).alias("score"), F.count("*").alias("neighbours"))
    return cut(scores, "scores")  # three numbers a query; maps and sizes read them more than once


def image_scores(patches: DataFrame, method: str = "max_patch", fraction: float = 0.1) -> DataFrame:
    """image_id, score from (image_id, id, score): the largest, or the mean of the largest ceil(n * fraction)."""
    if method == "max_patch":
        return patches.groupBy("image_id").agg(F.max("score").alias("score"), F.count("*").alias("patches"))
    if method != "top_fraction_mean":
        raise ValueError("method must be max_patch or top_fraction_mean")
    w = Window.partitionBy("image_id")
    r = patches.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "id"))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("r") <= F.ceil(F.col("n") * F.lit(fraction))).groupBy("image_id").agg(F.round(F.avg("score"), 6).alias("score"), F.first("n").alias("patches"))


def benchmark(patches: DataFrame, reference: DataFrame, labels: DataFrame, threshold: float, method: str = "max_patch", fraction: float = 0.1, k: int = 1, metric: str = "euclidean") -> DataFrame:
    """metric_summary of a labelled split: patches (image_id, id, v) are scored against the reference, images by their
    patches, and images at or above the threshold are selected.

    labels holds image_id and label (0, 1 or null) of every image of the split; images without patches have no score,
    patches of other images are left out. Roles that do not fit together raise ValueError.
    """
    own = patches.join(labels.select("image_id").distinct(), "image_id", "left_semi")
    check_compatible(own, reference)
    scored = patch_scores(own, reference, k, metric).join(own.select("id", "image_id"), "id")
    images = image_scores(scored, method, fraction).select(F.col("image_id").alias("id"), "score")
    rows = labels.select(F.col("image_id").alias("id"), "label").join(images, "id", "left")
    rows = cut(rows, "benchmark")  # a row for each image, read three times
    return metric_summary(rows.withColumn("selected", F.col("score") >= threshold))


def spatial_map(patches: DataFrame, within: str = "mean", across: str = "max") -> DataFrame:
    """image_id, px, py, value, coverage of every pixel that a patch (image_id, scale, x, y, w, h, score) covers."""
    return rasters.pixels(rasters.draw(patches, None, within, across))


def display(pixels: DataFrame) -> DataFrame:
    """value scaled to 0..1 in each image as `shown`; constant images give 0. Maps as tiles have rasters.display."""
    pixels = cut(pixels, "pixels")  # read twice, and drawn once
    ends = pixels.groupBy("image_id").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low"))
    return pixels.join(ends, "image_id").withColumn("shown", F.round(F.coalesce((F.col("value") - F.col("_low")) / span, F.lit(0.0)), 6)).drop("_low", "_high")


def smooth(pixels: DataFrame, sigma: float, sizes: DataFrame | None = None) -> DataFrame:
    """image_id, px, py, value, coverage after a Gaussian over each whole image (rasters.smooth), of the pixels given.

    sizes holds image_id, width and height; without it an image ends with its last covered pixels.
    """
    return rasters.pixels(rasters.smooth(rasters.of_pixels(pixels, sizes), sigma))


def whole(vectors: DataFrame, most: int) -> DataFrame:
    """The coreset of strategy "none": every vector id, or ValueError where there are more than `most`."""
    n = vectors.count()
    if n > most:
        raise ValueError(f"{n} vectors exceed the limit of {most}; choose farthest_first")
    return vectors.select("id")
