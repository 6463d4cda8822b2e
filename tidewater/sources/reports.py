"""Folders of JSON reports as rows, and rules that all of them are held to in one plan.

A report is a VARIANT, so fields that are absent, null or of another kind than expected are told apart without a schema,
and one broken file is a row with an error, not the end of the scan. Rules are columns over it: what a rule says is an
error or a warning of that file. Numbers that JSON cannot hold (NaN) make a file invalid JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of reports, of their sections of evidence and of the signals of reviews.
REQUIRED = ("project_name", "run_id", "run_metadata", "candidate_anomalies", "candidate_unknown_concepts", "human_review_required")
FLAGS = {
    "reference_scoring_summary": ("calibrated",),
    "spatial_anomaly_map_summary": (),
    "calibration_summary": ("calibrated", "labels_available"),
    "threshold_operating_point_summary": ("calibrated",),
    "benchmark_validation_summary": ("labels_available",),
}
COUNTS = {
    "reference_scoring_summary": "candidate_count",
    "spatial_anomaly_map_summary": "map_count",
    "calibration_summary": "sample_count",
    "threshold_operating_point_summary": "operating_point_count",
    "benchmark_validation_summary": "sample_count",
}
SIGNAL = ("priority_delta", "matched_feedback_count", "positive_feedback_count", "negative_feedback_count", "known_pattern_count", "duplicate_count", "notes", "explanation")
TEMPORAL_TEXTS = ("sequence_id", "dataset_name", "dataset_version", "range_start", "range_end")
TEMPORAL_SCORES = ("max_change_score", "mean_adjacent_change_score")
ORDERS = ("timestamp", "sequence_index")
STRATEGIES = ("adjacent_difference", "baseline_difference")
NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "SMALLINT", "TINYINT")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """path, value (the whole text) of every .json file below a folder."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def part(of: Column | str, path: str) -> Column:
    return F.try_variant_get(of, f"$.{path}", "variant")


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID (a JSON null), a kind of number, or null where nothing is."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text(v: Column) -> Column:
    """The text of a JSON string, null of anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def is_kind(v: Column, *names: str) -> Column:
    return F.coalesce(kind(v).isin(*names), F.lit(False))


def filled(v: Column) -> Column:
    return F.coalesce(F.trim(text(v)) != "", F.lit(False))


def items(v: Column) -> Column:
    """The items of a JSON array; none of anything else."""
    return F.coalesce(F.when(is_kind(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.array().cast("array<variant>"))


def empty(v: Column) -> Column:
    """Whether an id is missing: absent, null, false, 0, an empty text, list or object."""
    return v.isNull() | F.coalesce(F.to_json(v).isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def true(v: Column) -> Column:
    return F.coalesce(is_kind(v, "BOOLEAN") & F.try_variant_get(v, "$", "boolean"), F.lit(False))


def whole_number(v: Column) -> Column:
    return is_kind(v, *NUMBERS) & F.coalesce(F.to_json(v).rlike(r"^\d+$"), F.lit(False))


def _rules() -> list[Column]:
    """Errors of a report, each null where the rule holds."""
    r = "report"
    out = [F.when(part(r, f).isNull(), f"Missing required report field: {f}") for f in REQUIRED]
    out.append(F.when(~true(part(r, "human_review_required")), "human_review_required must be true."))
    for f in ("candidate_anomalies", "candidate_unknown_concepts"):
        out.append(F.when(~is_kind(part(r, f), "ARRAY", "VOID") & part(r, f).isNotNull(), f"{f} must be a list."))
    out.append(F.when(~is_kind(part(r, "review_memory_summary"), "OBJECT", "VOID") & part(r, "review_memory_summary").isNotNull(), "review_memory_summary must be an object when present."))
    for section, flags in FLAGS.items():
        s = part(r, section)
        whole = is_kind(s, "OBJECT") & (F.to_json(s) != "{}")
        out.append(F.when(s.isNotNull() & ~whole, f"{section} must be a non-empty object when present."))

        def inside(bad: Column, message: str, whole: Column = whole, section: str = section) -> None:
            out.append(F.when(whole & bad, f"{section}{message}"))

        inside(~filled(part(s, "artifact_path")), ".artifact_path must be a non-empty string.")
        inside(~F.coalesce(text(part(s, "artifact_fingerprint")).rlike("^[0-9a-f]{64}$"), F.lit(False)), ".artifact_fingerprint must be a lowercase SHA-256 digest.")
        inside(~true(part(s, "requires_human_review")), ".requires_human_review must be true.")
        for f in flags:
            inside(~is_kind(part(s, f), "BOOLEAN"), f".{f} must be a boolean.")
        count = part(s, COUNTS[section])
        inside(count.isNotNull() & ~whole_number(count), f".{COUNTS[section]} must be a non-negative integer.")
        if section == "spatial_anomaly_map_summary":
            shown = part(s, "preview_paths")
            inside(shown.isNotNull() & (~is_kind(shown, "ARRAY") | F.exists(items(shown), lambda x: ~F.coalesce(F.lower(text(x)).endswith(".png"), F.lit(False)))), ".preview_paths must be a list of PNG paths.")
        if section == "benchmark_validation_summary":
            metrics = part(s, "metrics")
            inside(~filled(part(s, "dataset_name")), ".dataset_name must be a non-empty string.")
            values = F.map_values(F.coalesce(F.try_variant_get(metrics, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
            inside(metrics.isNotNull() & ~is_kind(metrics, "VOID") & (~is_kind(metrics, "OBJECT") | F.exists(values, lambda x: ~is_kind(x, *NUMBERS))), ".metrics must contain finite numeric values.")
    return out


def _warnings() -> list[Column]:
    """Arrays of warnings of a report."""
    out = []

    def lacks(key: str):
        return lambda x, i: F.when(is_kind(x, "OBJECT") & empty(part(x, key)), F.concat(F.lit(f"{key} missing for item "), (i + 1).cast("string"), F.lit(".")))

    for field, key in (("candidate_anomalies", "anomaly_id"), ("candidate_unknown_concepts", "concept_id")):
        out.append(F.transform(items(part("report", field)), lacks(key)))
    for field in ("candidate_anomalies", "candidate_unknown_concepts"):

        def signal(x: Column, i: Column) -> Column:
            s = part(x, "review_memory_signal")
            lacking = F.array_compact(F.array(*[F.when(part(s, f).isNull(), f) for f in sorted(SIGNAL)]))
            at = (i + 1).cast("string")
            odd = F.concat(F.lit("review_memory_signal must be an object for item "), at, F.lit("."))
            some = F.concat(F.lit("review_memory_signal missing fields for item "), at, F.lit(": "), F.array_join(lacking, ", "))
            return F.when(is_kind(x, "OBJECT") & s.isNotNull() & ~is_kind(s, "OBJECT"), odd).when(is_kind(x, "OBJECT") & is_kind(s, "OBJECT") & (F.size(lacking) > 0), some)

        out.append(F.transform(items(part("report", field)), signal))
    return out


def _temporal_rules() -> list[Column]:
    r, s = "report", part("report", "sequence_summary")
    out = [F.when(~true(part(r, "human_review_required")), "human_review_required must be true."), F.when(~is_kind(s, "OBJECT"), "sequence_summary must be an object.")]
    out += [F.when(~F.coalesce(text(part(s, f)) != "", F.lit(False)), f"sequence_summary.{f} must be a non-empty string.") for f in TEMPORAL_TEXTS]
    for f, names in (("ordering_mode", ORDERS), ("strategy", STRATEGIES)):
        out.append(F.when(~F.coalesce(text(part(s, f)).isin(*names), F.lit(False)), f"sequence_summary.{f} is unsupported."))
    out += [F.when(~is_kind(part(s, f), *NUMBERS), f"sequence_summary.{f} must be finite.") for f in TEMPORAL_SCORES]
    ids = part(r, "observation_ids")
    names = F.transform(items(ids), text)
    enough = (F.size(names) >= 2) & ~F.exists(names, lambda x: x.isNull() | (x == ""))
    out.append(F.when(~enough, "observation_ids must contain at least two non-empty strings."))
    out.append(F.when(enough & (F.size(F.array_distinct(names)) < F.size(names)), "observation_ids must be unique."))
    n = part(s, "observation_count")
    out.append(F.when(enough & ~F.coalesce(whole_number(n) & (F.try_variant_get(n, "$", "long") == F.size(names)), F.lit(False)), "sequence_summary.observation_count must match observation_ids."))
    known = F.when(enough, names).otherwise(F.array().cast("array<string>"))
    pair = F.transform(items(part(s, "strongest_observation_pair")), text)
    out.append(F.when((F.size(pair) != 2) | F.exists(pair, lambda x: ~F.coalesce(F.array_contains(known, x), F.lit(False))), "sequence_summary.strongest_observation_pair must reference observations."))
    events = part(r, "candidate_change_events")
    out.append(F.when(~is_kind(events, "ARRAY"), "candidate_change_events must be a list."))
    ranks = F.transform(items(events), lambda e: F.try_variant_get(e, "$.rank", "long"))
    out.append(F.when(F.exists(F.transform(ranks, lambda x, i: ~F.coalesce(x == i + 1, F.lit(False))), lambda b: b), "candidate_change_events must be ranked from 1 without gaps."))
    scores = F.transform(items(events), lambda e: part(e, "change_score"))
    out.append(F.when(F.exists(scores, lambda x: ~is_kind(x, *NUMBERS)), "candidate_change_events need finite scores."))
    for f in ("warnings", "limitations"):
        v = part(r, f)
        out.append(F.when(~is_kind(v, "ARRAY") | F.exists(items(v), lambda x: text(x).isNull()), f"{f} must be a list of strings."))
    return out


def validate(reports: DataFrame) -> DataFrame:
    """path, report_type, is_valid, errors, warnings of reports (path, value); one row each, from one plan.

    A report whose report_type is a text starting with temporal is held to the rules of reports of change over time.
    """
    r = reports.withColumn("report", F.try_parse_json("value"))
    told = F.coalesce(text(part("report", "report_type")), F.lit("discovery"))
    broken = F.col("report").isNull()
    no_object = ~broken & ~is_kind(F.col("report"), "OBJECT")
    temporal = told.startswith("temporal")
    found = F.when(broken, F.array(F.lit("Report is not valid JSON."))).when(no_object, F.array(F.lit("Report root must be a JSON object.")))
    found = found.when(temporal, F.array_compact(F.array(*_temporal_rules()))).otherwise(F.array_compact(F.array(*_rules())))
    warned = F.when(broken | no_object | temporal, F.array().cast("array<string>")).otherwise(F.array_compact(F.concat(*_warnings())))
    return r.select("path", F.when(~broken & ~no_object, told).alias("report_type"), found.alias("errors"), warned.alias("warnings")).select("path", "report_type", (F.size("errors") == 0).alias("is_valid"), "errors", "warnings")
