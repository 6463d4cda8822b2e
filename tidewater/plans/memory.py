"""Reference memories: built from a folder of ordinary images, published, and used to score other images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..operators import evaluation, images, reference
from ..sources import tables
from . import artifacts
from .config import load

CORESETS = ("none", "farthest_first")


def build(spark: SparkSession, folder: str, out: str, sizes: tuple[int, ...] = (64,), strides: tuple[int, ...] = (64,), coreset: str = "none", most: int = 10_000, ratio: float = 1.0, seed: int = 0, metric: str = "euclidean") -> dict:
    """Publish the features of the patches of a folder's images, or a coreset of them, below `out`; a summary.

    A memory of the same images and options is left as it is, another one in its place raises ValueError, as do a folder
    without readable images and, without a coreset, more than `most` vectors. Ids are hashes of the patches' names. The
    images' fingerprints are published beside the vectors.
    """
    if coreset not in CORESETS:
        raise ValueError(f"coreset must be one of {CORESETS}")
    files = tables.fingerprints(spark, folder)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*images.SUFFIXES))
    options = {"sizes": list(sizes), "strides": list(strides), "coreset": coreset, "most": most, "ratio": ratio, "seed": seed, "metric": metric}
    identity = {"images": tables.digest(files.select("sha256", "size")), "options": options}
    p = images.patches(images.scan(spark, folder), sizes, strides).withColumn("id", F.xxhash64("patch_id"))
    v = p.select("id", "v").persist()  # decoded once; the choice reads it more than once
    try:
        n = v.count()
        if not n:
            raise ValueError(f"no readable images in {folder}")
        chosen = reference.whole(v, most) if coreset == "none" else reference.farthest_first(v, ratio, most, seed, metric=metric).select("id")
        kept = p.join(chosen, "id", "left_semi").select("id", "patch_id", F.col("path").alias("source"), "scale", "x", "y", "w", "h", "v")
        manifest = tables.publish(kept, f"{out}/vectors", identity)
        tables.publish(files, f"{out}/files", identity)
    finally:
        v.unpersist()
    return {"memory_id": manifest["identity"], "vectors": manifest["rows"], "patches": n, "metric": metric, "dimensions": len(images.FEATURES)}


def score(spark: SparkSession, memory: str, folder: str, sizes: tuple[int, ...] = (64,), strides: tuple[int, ...] = (64,), k: int = 1, metric: str = "euclidean", method: str = "max_patch", fraction: float = 0.1) -> tuple[DataFrame, DataFrame, dict]:
    """Images (path, score, patches), their patches (with score), and what the scores were made of.

    scoring_id is a digest of the images, the memory, the options and the scores, so equal runs have equal ids. An image
    whose content is in the memory raises ValueError.
    """
    files = tables.fingerprints(spark, folder)
    files = files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*images.SUFFIXES))
    tables.reject_shared(tables.load_published(spark, f"{memory}/files"), files)
    vectors = tables.load_published(spark, f"{memory}/vectors").select("id", "v")
    p = images.patches(images.scan(spark, folder), sizes, strides).withColumn("id", F.xxhash64("patch_id"))
    reference.check_compatible(p.select("id", "v"), vectors)
    scored = p.drop("v").join(reference.patch_scores(p.select("id", "v"), vectors, k, metric).select("id", "score"), "id")
    whole = reference.image_scores(scored.withColumnRenamed("path", "image_id"), method, fraction).withColumnRenamed("image_id", "path")
    options = {"sizes": list(sizes), "strides": list(strides), "k": k, "metric": metric, "method": method, "fraction": fraction}
    made = {"memory_id": tables.read_manifest(spark, f"{memory}/vectors").identity, "images": tables.digest(files.select("sha256", "size")), "options": options, "scores": tables.digest(scored.select("x", "y", "w", "h", "scale", "score"))}
    return whole, scored, {**made, "scoring_id": tables.canonical_sha256(made)}


def score_with(spark: SparkSession, memory: str, folder: str, out: str, options: dict | None = None, baseline: DataFrame | None = None) -> str:
    """Score a folder by the options' reference_scoring, patches by those of preprocessing, and publish the result with its
    maps and previews; the folder below `out` that holds it.

    With baseline scores (path, score) the image scores are calibrated by the options' calibration as well.
    """
    cfg = load(options)
    how, pre = cfg["reference_scoring"], cfg["preprocessing"]
    whole, scored, made = score(spark, memory, folder, tuple(pre["patch_sizes"]), tuple(pre["patch_strides"]), how["neighbor_count"], how["metric"], how["image_aggregation"], how["top_fraction"])
    method = cfg["calibration"]["method"]
    if method != "identity" and baseline is None:
        raise ConfigurationError(f"calibration by {method} needs baseline scores")
    own = whole.select(F.col("path").alias("id"), "score", "patches")
    calibrated = evaluation.calibrate(baseline.select("score") if baseline is not None else own, own, method)
    made = {**made, "options": {k: cfg[k] for k in ("preprocessing", "reference_scoring", "calibration")}}
    made["scoring_id"] = tables.canonical_sha256({k: v for k, v in made.items() if k != "scoring_id"})
    return artifacts.publish_scoring(calibrated.withColumnRenamed("id", "path"), scored, images.dimensions(images.scan(spark, folder)), made, out, options)


def publish_scores(scored: DataFrame, made: dict, out: str) -> dict:
    """Publish the maps (pixels with value and coverage) of scored patches under the id of their scoring."""
    maps = reference.spatial_map(scored.withColumnRenamed("path", "image_id"))
    return tables.publish(maps, f"{out}/maps", {"scoring_id": made["scoring_id"]})


def publish_evaluation(rows: DataFrame, out: str, least: dict[str, float], most: dict[str, float], identity: dict) -> DataFrame:
    """Publish metric_summary of rows (id, label, score, selected) as a baseline, and give its gates' results."""
    tables.publish(evaluation.metric_summary(rows), f"{out}/baseline", identity)
    return evaluation.acceptance(tables.load_published(rows.sparkSession, f"{out}/baseline", identity), least, most)
