"""Published results: named by their content, written once, and checked when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError, IntegrityError
from ..operators import previews, rasters
from ..sources import tables
from ..sources.files import write_files
from ..sources.scratch import cut, drop
from .config import load

# Kinds of results, and the map options' names for ways to combine patches.
KINDS = ("temporal_change", "calibration", "benchmark", "acceptance")
PROJECTIONS = {"overlap_mean": "mean", "overlap_max": "max"}


def _name(kind: str, df_columns: list[str], rows: int, digest: str) -> str:
    return tables.canonical_sha256({"kind": kind, "columns": list(df_columns), "rows": rows, "digest": digest})


def publish_result(df: DataFrame, out: str, kind: str) -> str:
    """Publish the rows of a result below `out` under the digest of its kind, columns and rows; the name.

    A result that is there already raises IntegrityError: results are never written over.
    """
    if kind not in KINDS:
        raise ConfigurationError(f"kind must be one of {KINDS}", context={"kind": kind})
    stale: list[str] = []
    df = cut(df, "result", stale)  # computed once: for its name, and for its place
    try:
        name = _name(kind, df.columns, *tables.digest(df))
        if tables.read_manifest(df.sparkSession, f"{out}/{name}") is not None:
            raise IntegrityError("the result is published already", context={"id": name})
        tables.publish(df, f"{out}/{name}", {"kind": kind, "id": name})
        return name
    finally:
        drop(df.sparkSession, stale)


def load_result(spark: SparkSession, out: str, name: str, kind: str) -> DataFrame:
    """The rows of a published result, after a look at its kind and content."""
    df = tables.load_published(spark, f"{out}/{name}", {"kind": kind, "id": name})
    there = tables.read_manifest(spark, f"{out}/{name}")
    if _name(kind, there.columns, there.rows, there.digest) != name:
        raise IntegrityError("the result's name is not that of its content", context={"id": name})
    return df


def maps(scored: DataFrame, sizes: DataFrame, options: dict | None = None) -> DataFrame:
    """Tiles of the maps of scored patches (path, scale, x, y, w, h, score) of images (path, width, height), by the options
    map_projection, multi_scale_fusion and smoothing_sigma."""
    cfg = load(options)["reference_scoring"]
    as_image = lambda df: df.withColumnRenamed("path", "image_id")
    tiles = rasters.draw(as_image(scored), as_image(sizes), PROJECTIONS[cfg["map_projection"]], cfg["multi_scale_fusion"])
    return rasters.smooth(tiles, cfg["smoothing_sigma"])


def publish_scoring(images: DataFrame, scored: DataFrame, sizes: DataFrame, made: dict, out: str, options: dict | None = None) -> str:
    """Publish a scoring below its id: image scores, maps as tiles, a preview of each map, and what the previews hold.

    The table of previews comes last, so a scoring without it is one that a broken run left: validate_scoring says so,
    and publishing again under another `out`, or after the folder is removed, goes through.
    """
    spark, at, identity = images.sparkSession, f"{out}/{made['scoring_id']}", {"scoring_id": made["scoring_id"], "made": str(sorted(made))}
    if tables.read_manifest(spark, f"{at}/previews") is not None:
        raise IntegrityError("the scoring is published already", context={"scoring_id": made["scoring_id"]})
    tables.publish(images, f"{at}/images", identity)
    tables.publish(maps(scored, sizes, options), f"{at}/maps", identity)
    tiles = tables.load_published(spark, f"{at}/maps", identity, verify=False)
    stale: list[str] = []
    made_of = previews.map_previews(tiles).select("image_id", F.concat(previews.safe_name("image_id"), F.lit(".png")).alias("name"), "content")
    made_of = cut(made_of, "previews", stale)
    write_files(made_of, f"{at}/png")
    tables.publish(made_of.select("image_id", "name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256")), f"{at}/previews", identity)
    drop(spark, stale)
    return at


def validate_scoring(spark: SparkSession, at: str) -> dict:
    """Rows of the tables of a published scoring, all of them verified; missing, changed and unexpected previews raise."""
    out = {}
    for name in ("images", "maps", "previews"):
        out[name] = tables.load_published(spark, f"{at}/{name}").count()
    odd = tables.verify_files(tables.load_published(spark, f"{at}/previews"), f"{at}/png").where("status <> 'ok'").orderBy("name").limit(5).collect()
    if odd:
        raise IntegrityError(f"previews are not as published: {[(r.name, r.status) for r in odd]}")
    return out
