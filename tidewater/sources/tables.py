"""Delimited files as tables of text cells, with numbered rows; and manifests and content fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import IntegrityError, ManifestError, RoleError
from ..functions.scalars import clean_cell, parse_timestamp
from . import reports
from .files import Claim
from .scratch import cut

# Names under which a column of times is found.
TIME_NAMES = ("timestamp", "time", "datetime", "date", "ts")


def read_csv(spark: SparkSession, path: str, prefix: str = "row") -> DataFrame:
    """All columns as trimmed text ('' where a short row has none), with row_index from 1 in file order and record_id.

    Rows may hold quoted line ends. Fields beyond the header are dropped; extra_field_rows() counts such rows.
    """
    _csv_file(spark, path)
    raw = _csv_reader(spark).csv(path)
    if not raw.columns:
        raise ValueError(f"file is empty: {path}")
    names = [c.lstrip("﻿").strip() for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names are not unique")
    df = raw.toDF(*names).select(*[clean_cell(F.col(f"`{n}`")).alias(n) for n in names])
    # the upper bits of the id are the task's number, the lower ones the row's place in the task
    placed = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_id", 33))
    past = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("_task").agg(F.count("*").alias("_n")).select("_task", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"))  # a row for each task
    numbered = placed.join(F.broadcast(before), "_task").select(*df.columns, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).alias("row_index"))
    return numbered.withColumn("record_id", F.format_string(f"{prefix}-%06d", "row_index"))


def extra_field_rows(spark: SparkSession, path: str) -> DataFrame:
    """Records with more fields than the header, whole, with the line ends and commas they quote; for warnings."""
    raw = _csv_reader(spark).csv(path)
    fields = ", ".join(f"_f{i} string" for i in range(len(raw.columns)))
    odd = _csv_reader(spark).option("columnNameOfCorruptRecord", "_record").schema(f"{fields}, _record string").csv(path)
    # Spark refuses plans that read the odd record alone, so another column takes part
    odd = odd.where("_record is not null and length(concat(coalesce(_f0, ''), 'x')) > 0").select("_record")
    # short records are odd too, but no fault
    count = F.size(F.split(F.regexp_replace("_record", r'"(?:[^"]|"")*"', "q"), ","))
    return odd.where(count > len(raw.columns)).select(F.rtrim(F.col("_record"), F.lit("\r\n")).alias("value"))


def _csv_reader(spark: SparkSession):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")


def _csv_file(spark: SparkSession, path: str) -> None:
    """ValueError unless the path is a .csv file, a folder of parts or a pattern that names something."""
    if not path.lower().endswith(".csv"):
        raise ValueError(f"not a .csv file: {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at):
        raise ValueError(f"no such file: {path}")


def time_column(columns: list[str], wanted: str | None = None) -> str:
    if wanted is not None:
        if wanted not in columns:
            raise ValueError(f"no column {wanted!r}")
        return wanted
    lower = {c.lower(): c for c in reversed(columns)}
    for name in TIME_NAMES:
        if name in lower:
            return lower[name]
    raise ValueError(f"Could not detect a time column among {columns}")


def read_timeseries_csv(spark: SparkSession, path: str, time: str | None = None, entity: str | None = None) -> DataFrame:
    """read_csv with the time parsed into `ts` (null where it is malformed) and the entity as `entity`."""
    df = read_csv(spark, path, "ts")
    t = time_column([c for c in df.columns if c not in ("row_index", "record_id")], time)
    if entity is not None and entity not in df.columns:
        raise ValueError(f"no column {entity!r}")
    out = df.withColumn("_ts", parse_timestamp(F.col(f"`{t}`")))
    out = out.drop(t).withColumnRenamed("_ts", "ts") if t == "ts" else out.withColumnRenamed("_ts", "ts")
    return out.withColumn("entity", F.col(f"`{entity}`")) if entity and entity != "entity" else out


def fingerprints(spark: SparkSession, path: str, max_files: int = 100_000, max_mb: int = 1024) -> DataFrame:
    """path, size, sha256 of every file below a folder; hashing runs where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    sizes = files.select("path", "length").agg(F.count("*").alias("n"), F.max("length").alias("m")).first()
    if sizes.n > max_files or (sizes.m or 0) > max_mb << 20:
        raise ValueError(f"{sizes.n} files, the largest of {sizes.m} bytes, exceed the limits")
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def dataset_fingerprint(files: DataFrame, with_paths: bool = True, config: dict | None = None) -> str:
    """SHA-256 over the sorted rows, whatever their order; files are few beside their contents."""
    rows = sorted([r.path if with_paths else "", r.sha256, r.size] for r in files.collect())
    return canonical_sha256({"config": config, "files": rows})


def canonical_sha256(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def verify_files(expected: DataFrame, folder: str) -> DataFrame:
    """name and status (ok, missing, changed, unexpected) of every file that is expected (name, sha256) or lies below the
    folder; a null sha256 asks for existence alone. Files are hashed where they are read."""
    spark = expected.sparkSession
    schema = "path string, modificationTime timestamp, length long, content binary"
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], schema)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/"
    place = F.locate(top, F.col("path"))
    seen = files.select("path", F.sha2("content", 256).alias("found")).withColumn("name", F.substring("path", place + len(top), F.length("path")))
    both = expected.select("name", "sha256", F.lit(True).alias("_e")).join(seen.select("name", "found"), "name", "full")
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("found").isNull(), "missing").when(F.coalesce(F.lower("sha256"), F.col("found")) != F.col("found"), "changed").otherwise("ok")
    return both.select("name", status.alias("status"))


def temporal_manifest(text: str) -> list[dict]:
    """Observations of a JSON manifest: two or more, all with a timestamp or all with an index, keys and ids unique."""
    data = json.loads(text)
    obs = data.get("observations") if isinstance(data, dict) else None
    if not isinstance(obs, list) or len(obs) < 2:
        raise ManifestError("a sequence needs two observations")
    kinds = {("timestamp" in o, "sequence_index" in o) for o in obs}
    if kinds not in ({(True, False)}, {(False, True)}):
        raise ManifestError("observations need a timestamp, or all a sequence_index")
    key = "timestamp" if "timestamp" in obs[0] else "sequence_index"
    if len({o[key] for o in obs}) != len(obs) or len({o["observation_id"] for o in obs}) != len(obs):
        raise ManifestError("order keys and ids must be unique")
    for o in obs:
        p = PurePosixPath(o["source_path"].replace("\\", "/"))
        if p.is_absolute() or ".." in p.parts or re.match(r"^[A-Za-z]:", str(p)):
            raise ManifestError(f"path leaves its folder: {p}", context={"path": str(p)})
    return [{"observation_id": o["observation_id"], "source_path": o["source_path"], "order_key": o[key]} for o in obs]


def benchmark_manifest(spark: SparkSession, text: str) -> DataFrame:
    """sample_id, path, label, sha256 of a JSON manifest with unique ids and paths and known labels."""
    samples = json.loads(text)["samples"]
    ids, paths = [s["sample_id"] for s in samples], [s["path"] for s in samples]
    if len(set(ids)) != len(ids) or len(set(paths)) != len(paths):
        raise ValueError("sample ids and paths must be unique")
    if bad := {s["label"] for s in samples} - {"normal", "anomaly", "unknown"}:
        raise ValueError(f"unknown labels: {sorted(bad)}")
    return spark.createDataFrame([(s["sample_id"], s["path"], s["label"], s.get("sha256")) for s in samples], "sample_id string, path string, label string, sha256 string")


SAMPLES = "sample_id string, split string, label string, image_path string, image_sha256 string, mask_path string, mask_sha256 string"


def manifest_samples(spark: SparkSession, path: str) -> DataFrame:
    """A row for each sample of a benchmark manifest in a JSON file with splits of samples; ManifestError if it is none."""
    value = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("m"))
    told = value.select(*[reports.text(reports.part("m", f)).alias(f) for f in ("dataset_name", "dataset_version")], reports.kind(reports.part("m", "splits")).alias("splits")).first()
    if told is None or not (told.dataset_name or "").strip() or not (told.dataset_version or "").strip() or told.splits != "ARRAY":
        raise ManifestError("a manifest needs a dataset_name, a dataset_version and splits", context={"path": path})
    splits = value.select(F.explode(reports.items(reports.part("m", "splits"))).alias("s"))
    samples = splits.select(reports.text(reports.part("s", "name")).alias("split"), F.explode(reports.items(reports.part("s", "samples"))).alias("x"))
    fields = ("label", "image_path", "image_sha256", "mask_path", "mask_sha256")
    return samples.select(reports.text(reports.part("x", "sample_id")).alias("sample_id"), "split", *[reports.text(reports.part("x", f)).alias(f) for f in fields])


def check_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """sample_id, name, problem of every sample of a manifest that breaks a rule: ids and image paths are unique and
    filled, labels known, paths relative and plain, digests SHA-256, files there and as their digests say.

    Files are hashed where they are read; problems are few rows beside them. No rows: the manifest holds.
    """
    s = cut(manifest_samples(spark, path), "samples")
    spot = lambda rows, name, problem: rows.select("sample_id", F.col(name).cast("string").alias("name"), F.lit(problem).alias("problem"))
    twice = lambda c: s.join(s.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1"), c)
    odd_path = lambda c: F.col(c).rlike(r"^/|\\\\|^[A-Za-z]:|//|/$|(^|/)\.\.?(/|$)") | (F.col(c) == "")
    odd_digest = lambda c: ~F.col(c).rlike("^[0-9a-f]{64}$")
    found = [
        spot(s.where("sample_id is null or trim(sample_id) = ''"), "image_path", "sample without an id"),
        spot(twice("sample_id"), "image_path", "id of another sample"),
        spot(s.where("image_path is null"), "image_path", "sample without an image"),
        spot(twice("image_path"), "image_path", "image of another sample"),
        spot(s.where("label is null or label not in ('normal', 'anomaly', 'unknown')"), "label", "unknown label"),
    ]
    kinds = [F.struct(F.col(f"{k}_path").alias("name"), F.col(f"{k}_sha256").alias("sha256")) for k in ("image", "mask")]
    files = s.select("sample_id", F.explode(F.array(*kinds)).alias("f")).select("sample_id", "f.*").where("name is not null")
    found += [spot(files.where(odd_path("name")), "name", "path is not plain"), spot(files.where(odd_digest("sha256")), "name", "not a digest")]
    expected = files.where(~odd_path("name")).groupBy("name").agg(F.max("sha256").alias("sha256"))
    odd = verify_files(expected, root).where("status in ('missing', 'changed')")
    found.append(files.join(odd, "name").select("sample_id", "name", F.concat(F.lit("file is "), F.col("status")).alias("problem")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def require_manifest(spark: SparkSession, path: str, root: str) -> DataFrame:
    """The samples of a manifest that holds; ManifestError with the first problems otherwise, and for no samples at all."""
    samples = manifest_samples(spark, path)
    if not samples.limit(1).count():
        raise ManifestError("a manifest needs a sample", context={"path": path})
    odd = check_manifest(spark, path, root).orderBy("sample_id", "name", "problem").limit(5).collect()
    if odd:
        raise ManifestError(f"the manifest does not hold: {[(r.sample_id, r.name, r.problem) for r in odd]}", context={"problems": [r.asDict() for r in odd]})
    return samples


MANIFEST = "identity string, columns array<string>, rows long, digest string"


def digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of them in any order: sums of the quarters of their SHA-256."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"timeZone": "UTC", "ignoreNullFields": "false"}), 256)
    quarters = [F.sum(F.conv(F.substring(row, 16 * i + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"q{i}") for i in range(4)]
    n, *sums = df.agg(F.count("*").alias("n"), *quarters).first()
    return n, canonical_sha256([str(s) for s in sums])


def read_manifest(spark: SparkSession, path: str) -> Row | None:
    """The manifest of a published table; None where none was finished."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(df: DataFrame, path: str, identity: dict, stale_after: float = 600.0) -> dict:
    """Write df as Parquet once: an existing table of the same identity is left, another one raises.

    Data and manifest are written to a staging folder under a claim that one writer at a time can have, and moved to
    their place by one rename, so readers see all or nothing. A second writer raises Busy; what a killed one left is
    removed once its claim was not touched for `stale_after` seconds.
    """
    spark, name = df.sparkSession, canonical_sha256(identity)
    path = path.rstrip("/")
    there = read_manifest(spark, path)
    if there is None:
        with Claim(spark, path, stale_after) as claim:
            there = read_manifest(spark, path)  # finished meanwhile
            if there is None:
                at = claim.staging()
                df.write.parquet(f"{at}/data")
                n, rows = digest(spark.read.parquet(f"{at}/data"))
                made = (name, df.columns, n, rows)
                spark.createDataFrame([made], MANIFEST).coalesce(1).write.json(f"{at}/manifest")
                claim.commit()
                return dict(zip(("identity", "columns", "rows", "digest"), made))
    if there.identity != name:
        raise IntegrityError(f"{path} holds another table", context={"path": path})
    return there.asDict()


def load_published(spark: SparkSession, path: str, identity: dict | None = None, verify: bool = True) -> DataFrame:
    """The table, after a look at its identity, columns, and (a pass over the data) its number of rows and digest."""
    there = read_manifest(spark, path)
    if there is None:
        raise IntegrityError(f"{path} holds no finished table", context={"path": path})
    if identity is not None and there.identity != canonical_sha256(identity):
        raise IntegrityError("the table has another identity", context={"path": path})
    df = spark.read.parquet(f"{path}/data")
    if df.columns != list(there.columns):
        raise IntegrityError("the table's columns changed", context={"path": path})
    if verify and digest(df) != (there.rows, there.digest):
        raise IntegrityError("the table's rows changed", context={"path": path})
    return df


def labelled_folder(spark: SparkSession, root: str) -> DataFrame:
    """path, role (reference or query), label, kind, sha256, mask of the PNG files of a folder of inspected parts.

    The layout is train/good, test/good, test/<kind of fault> and ground_truth/<kind>/<stem>_mask.png; paths are relative
    to the root. An empty role, a fault without its mask, a mask without its fault, a file elsewhere in these folders and a
    file with the same content in both roles raise ValueError.
    """
    within = F.regexp_extract("path", r"/((?:train|test|ground_truth)/[^/]+/[^/]+)$", 1)
    files = fingerprints(spark, root).where(F.lower("path").endswith(".png")).select(within.alias("path"), "sha256")
    folder, kind, name = [F.get(F.split("path", "/"), F.lit(i)) for i in range(3)]
    files = files.select("path", "sha256", folder.alias("folder"), kind.alias("kind"), F.regexp_replace(name, r"(?i)\.png$", "").alias("stem"))
    files = cut(files, "inspected")  # hashed once
    masks = files.where("folder = 'ground_truth'").select("kind", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask"))
    images = files.where("folder in ('train', 'test')").join(masks, ["kind", "stem"], "left")
    fault = (F.col("folder") == "test") & (F.col("kind") != "good")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    seen = images.agg(n(F.col("folder") == "train").alias("reference"), n((F.col("folder") == "test") & ~fault).alias("normal"), n(fault).alias("faults"), n(fault & F.col("mask").isNull()).alias("bare"), n((F.col("folder") == "train") & (F.col("kind") != "good")).alias("odd")).first()
    lost = masks.join(images.where(fault), ["kind", "stem"], "left_anti").limit(1).count()
    if not (seen.reference and seen.normal and seen.faults):
        raise ValueError(f"train/good, test/good and a folder of faults need images: {seen.asDict()}")
    if seen.bare or seen.odd or lost or files.where("path = ''").limit(1).count():
        raise ValueError("faults without masks, masks without faults, or files out of place")
    out = images.select("path", F.when(F.col("folder") == "train", "reference").otherwise("query").alias("role"), F.when(fault, "anomaly").otherwise("normal").alias("label"), "kind", "sha256", "mask")
    reject_shared(out.where("role = 'reference'"), out.where("role = 'query'"))
    return out


def reject_shared(one: DataFrame, other: DataFrame) -> None:
    """ValueError if a file's content (sha256) is in both roles."""
    both = one.join(other, "sha256", "left_semi").limit(3).collect()
    if both:
        raise RoleError(f"the same content in both roles, such as {sorted(r.path for r in both)}", context={"paths": sorted(r.path for r in both)})
