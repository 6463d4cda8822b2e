"""Records of runs and reviews: append, keep the last of each key, and roll up."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.review import LABELS, SCHEMA

INDEX = "run_id string, created_at string, modality string, report_path string, anomalies long, concepts long"


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; an aggregation, so a hot key is combined before it is shuffled."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def upsert(index: DataFrame, new: DataFrame, key: str = "run_id", order: str = "created_at") -> DataFrame:
    """index with new rows in place of those of the same key."""
    both = index.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, ["_v", order]).drop("_v")


def dashboard(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("run_id").agg(F.count("*").alias("records"), F.count_distinct("target_id").alias("targets"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.sum((F.col("label") == "important").cast("long")).alias("important"))


def _read_json(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """JSON lines, and no rows where there is no such file yet."""
    try:
        return spark.read.schema(schema).options(**options).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_feedback(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict reading fails on a malformed line, else it comes as a `malformed` text. An absent file is empty."""
    if strict:
        return _read_json(spark, path, SCHEMA, mode="FAILFAST")
    return _read_json(spark, path, SCHEMA + ", malformed string", columnNameOfCorruptRecord="malformed")


def append_run(spark: SparkSession, run: tuple, path: str) -> None:
    """Add a run (the fields of INDEX) to the index; one of the same id takes the place of the earlier one."""
    spark.createDataFrame([run], INDEX).coalesce(1).write.mode("append").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of runs, the latest record of each; an absent file is an empty index."""
    return keep_last(_read_json(spark, path, INDEX), "run_id", ["created_at", "report_path"])


def label_rollup(feedback: DataFrame) -> DataFrame:
    """run_id, records, latest and, for each label that reviews may give, how many did."""
    counts = [F.count_if(F.col("label") == label).alias(f"n_{label}") for label in LABELS]
    return feedback.groupBy("run_id").agg(F.count("*").alias("records"), F.max("created_at").alias("latest"), *counts)


def last_records(feedback: DataFrame, n: int = 10) -> DataFrame:
    """position and the rows of the last n reviews of each run, the latest first, equal times by id.

    Ranks beyond n are dropped in every task before rows of a run meet, so a run with most of the reviews is no burden.
    """
    order = Window.partitionBy("run_id").orderBy(F.desc("created_at"), "feedback_id")
    return feedback.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def append_feedback(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def listing(reports: DataFrame, k: int = 25) -> DataFrame:
    """position, name, modified of the k reports changed last; equal times by name."""
    newest = reports.orderBy(F.desc("modified"), "name").limit(k)
    return newest.withColumn("position", F.row_number().over(Window.orderBy(F.desc("modified"), "name"))).select("position", "name", "modified")


def summary(runs: DataFrame, reports: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: how many runs (run_id, created_at), reports (name, modified, type), reports on change over time and
    reviews there are, and the latest run and report; null where there is none."""
    past = runs.agg(F.count("*").alias("run_count"), F.max_by("run_id", F.struct("created_at", "run_id")).alias("latest_run_id"))
    made = reports.agg(F.count("*").alias("report_count"), F.coalesce(F.sum((F.col("type") == "temporal").cast("long")), F.lit(0)).alias("temporal_report_count"))
    latest = listing(reports, 1).agg(F.max("name").alias("latest_report_name"))
    reviews = feedback.agg(F.count("*").alias("feedback_count"))
    return past.crossJoin(made).crossJoin(latest).crossJoin(reviews)  # one row each
