"""Where a table came from: the files its plan reads, its schema, the options and what was counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import tables

FILES = "path string, size long, modified timestamp, sha256 string"


def inputs(df: DataFrame, content: bool = False) -> DataFrame:
    """path, size, modified, sha256 of the files that the plan of df reads.

    The plan names them; sizes and times come from the file system. Contents are read and hashed only if `content` asks
    for it, else sha256 is null. A plan without files gives no rows.
    """
    spark, files = df.sparkSession, df.inputFiles()
    if not files:
        return spark.createDataFrame([], FILES)
    seen = spark.read.format("binaryFile").load(sorted(files))
    sha = F.sha2("content", 256) if content else F.lit(None).cast("string")
    return seen.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), sha.alias("sha256"))


def record(rows: int, columns: str, files: DataFrame, config: dict, content: bool) -> dict:
    """Numbers and digests of a run; `digest` is over all of them, so equal runs have equal ones.

    With hashed contents the times of the files do not count.
    """
    n, found = tables.digest(files.select("path", "size", "sha256") if content else files.select("path", "size", "modified"))
    size = files.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first().s
    made = {"inputs": n, "bytes": size, "files": found, "schema": columns, "config": tables.canonical_sha256(config), "rows": rows}
    return {**made, "digest": tables.canonical_sha256(made)}


def publish(df: DataFrame, path: str, config: dict, content: bool = False) -> dict:
    """Publish df at `path`/table and the files it was made of at `path`/inputs; the record of the run.

    The rows are counted as they are written. The table's identity is that of its inputs and options, so another run over
    the same ones leaves it, and one over changed inputs raises IntegrityError.
    """
    files = inputs(df, content)
    before = record(0, df.schema.json(), files, config, content)
    identity = {k: before[k] for k in ("files", "schema", "config")}
    seen = Observation()
    there = tables.read_manifest(df.sparkSession, f"{path}/table")
    made = tables.publish(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{path}/table", identity)
    if there is None and seen.get["rows"] != made["rows"]:
        raise tables.IntegrityError("rows were lost on the way", context={"counted": seen.get["rows"], "published": made["rows"]})
    tables.publish(files, f"{path}/inputs", identity)
    out = record(made["rows"], df.schema.json(), files, config, content)
    return out


def changes(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """path, change (changed, missing, new) of the files that df would read, against those a published table was made of.

    Contents are compared where they were hashed, else sizes and times.
    """
    old = tables.load_published(spark, f"{path}/inputs")
    hashed = old.where("sha256 is not null").limit(1).count() > 0
    new = inputs(df, hashed)
    is_same = F.col("o.sha256").eqNullSafe(F.col("n.sha256")) if hashed else (F.col("o.size") == F.col("n.size")) & (F.col("o.modified") == F.col("n.modified"))
    both = old.alias("o").join(new.alias("n"), F.col("o.path") == F.col("n.path"), "full")
    change = F.when(F.col("n.path").isNull(), "missing").when(F.col("o.path").isNull(), "new").when(~is_same, "changed")
    return both.select(F.coalesce("o.path", "n.path").alias("path"), change.alias("change")).where("change is not null")
