"""Whole analyses: from a file or folder to ranked findings, groups and a report for review."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import images, previews, profiling, review, selection, tabular, temporal, timeseries, vectors
from ..sources import runs, tables
from ..sources.files import write_files
from ..sources.scratch import cut
from .config import load

REQUIRED = ("run_id", "modality", "candidate_anomalies", "candidate_unknown_concepts", "human_review_required")
#: Sections of a report beside its tables of findings, in the order of rendering.
SECTIONS = {
    "dataset_summary": "Dataset",
    "sequence_summary": "Sequence",
    "profile": "Profile",
    "feature_summary": "Features",
    "score_summary": "Scores",
    "run_metadata": "Run",
}
NOTES = ["Findings are candidates for review; scores rank them and prove nothing.", "Confidence says what to look at first, not how likely a fault is."]


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def report(run_id: str, modality: str, findings: DataFrame, groups: DataFrame, project: str = "tidewater", source: str | None = None, options: dict | None = None, **more) -> dict:
    """A report of the top findings and their groups, both a few rows, for a human to review.

    run_metadata counts them and holds a digest of the options, so runs with equal options can be told by it.
    """
    found, held = _rows(findings), _rows(groups)
    run = {"run_id": run_id, "modality": modality, "source": source, "anomalies": len(found), "concepts": len(held), "options_sha256": tables.canonical_sha256(options or {})}
    return {"project_name": project, "run_id": run_id, "modality": modality, "run_metadata": run, "candidate_anomalies": found, "candidate_unknown_concepts": held, "human_review_required": True, "notes": NOTES, **more}


def _scores(scored: DataFrame) -> dict:
    return {k: v for k, v in profiling.score_distribution(scored, "score").first().asDict().items() if v is not None}


def analyse_tabular(spark: SparkSession, path: str, run_id: str = "run", options: dict | None = None) -> dict:
    cfg = load(options)
    df = tables.read_csv(spark, path)
    drop = ("row_index", "record_id", cfg["tabular"]["id_column"])
    columns = [c for c in df.columns if c not in drop]
    profile = _rows(profiling.tabular_profile(df, columns, cfg["tabular"]["max_categorical_cardinality"]))  # a row a column
    numeric, categorical = ([r["column"] for r in profile if r["detected_type"] == kind] for kind in ("numeric", "categorical"))
    scored = cut(tabular.tabular_novelty(df, "row_index", numeric, categorical, cfg["discovery"]["max_candidate_anomalies"]), "findings")
    found = scored.select("rank", F.format_string("row-%06d", "row_index").alias("anomaly_id"), "row_index", "score", "reason", "completeness", F.slice("deviations", 1, 5).alias("deviations"))
    extra = tables.extra_field_rows(spark, path).count()
    rows = profile[0]["missing_count"] + profile[0]["non_missing_count"] if profile else 0
    warnings = [f"{extra} rows have extra fields"] if extra else []
    warnings += [f"{r['column']} has {r['unique_count']} values" for r in profile if r["warning"]]
    return report(
        run_id, "tabular", found.orderBy("rank"), tabular.reason_groups(scored, cfg["discovery"]["max_concepts"]), source=path, options=cfg, warnings=warnings,
        dataset_summary={"rows": rows, "columns": len(profile), "numeric_columns": numeric, "categorical_columns": categorical, "missing_values": {r["column"]: r["missing_count"] for r in profile if r["missing_count"]}},
        profile=profile,
        feature_summary={"numeric_features": 2 * len(numeric), "categorical_features": 2 * len(categorical), "features": 2 * len(profile) + 1},
        score_summary=_scores(scored),
    )


def analyse_timeseries(spark: SparkSession, path: str, run_id: str = "run", options: dict | None = None) -> dict:
    cfg = load(options)
    ts = cfg["timeseries"]
    df = tables.read_timeseries_csv(spark, path, ts["timestamp_column"], ts["entity_column"])
    named = tables.time_column([c for c in df.columns if c not in ("row_index", "record_id")], ts["timestamp_column"]) if ts["timestamp_column"] != "ts" else "ts"
    entity = "entity" if ts["entity_column"] else None
    skip = ("row_index", "record_id", "ts", "entity", named, ts["entity_column"])
    signals, _ = profiling.roles(df.where("ts is not null"), [c for c in df.columns if c not in skip])
    scored = cut(timeseries.timeseries_novelty(df, "ts", entity, signals, "row_index", cfg["discovery"]["max_candidate_anomalies"], ts["window_size"]), "findings")
    found = scored.select("rank", F.format_string("ts-%06d", "row_index").alias("anomaly_id"), "row_index", F.col("ts").cast("string").alias("ts"), "score", "reason", F.slice("deviations", 1, 5).alias("deviations"))
    held = profiling.timeseries_profile(df, "ts", signals, entity).first().asDict()
    gaps = profiling.sampling_summary(df, "ts").first().asDict()
    twice = profiling.duplicate_keys(df, "ts", entity).first()[0]
    odd = {f"{held['row_count'] - held['valid_count']} rows have no readable time": held["row_count"] - held["valid_count"], f"{twice} rows repeat an entity's time": twice, "times are not evenly spaced": gaps["irregular"], f"{held['missing_signal_count']} signal cells are missing": held["missing_signal_count"]}
    return report(
        run_id, "timeseries", found.orderBy("rank"), tabular.reason_groups(scored, cfg["discovery"]["max_concepts"]), source=path, options=cfg, warnings=[k for k, v in odd.items() if v],
        dataset_summary={"rows": held["row_count"], "timestamp_column": named, "entity_column": ts["entity_column"], "entities": held["entity_count"], "first_time": held["first_time"], "last_time": held["last_time"], "signals": signals},
        profile={**gaps, "duplicate_times": twice, "missing_signal_cells": held["missing_signal_count"]},
        feature_summary={"signals": len(signals), "window_size": ts["window_size"]},
        score_summary=_scores(scored),
    )


def analyse_images(spark: SparkSession, path: str, run_id: str = "run", options: dict | None = None, feedback: DataFrame | None = None, previews_at: str | None = None) -> dict:
    """previews_at: a folder that gets a picture of each finding; findings then name theirs as `preview`."""
    cfg = load(options)
    d, pre = cfg["discovery"], cfg["preprocessing"]
    shots = images.scan(spark, path)
    p = cut(images.patches(shots, tuple(pre["patch_sizes"]), tuple(pre["patch_strides"])).withColumn("id", F.xxhash64("patch_id")).withColumnRenamed("path", "source"), "patches")
    scored = cut(vectors.novelty(p.select("id", "v"), d["novelty_strategy"], d["weight_global_distance"], d["weight_neighbor_distance"]), "scores")
    chosen = selection.diverse(scored.join(p, "id"), d["max_candidate_anomalies"], d["max_per_image"], d["min_spatial_distance"])
    clustered = cut(selection.leader_clusters(chosen, d["cluster_distance_threshold"]), "concepts")
    concepts = selection.concept_scores(clustered, d["max_concepts"]).join(selection.evidence(clustered), ["concept_id", "size"]).withColumn("hypothesis", selection.hypothesis())
    found = clustered.select(F.col("position").alias("rank"), F.format_string("anomaly-%04d", "position").alias("anomaly_id"), "patch_id", "source", "x", "y", "w", "h", "score", "concept_id")
    if previews_at is not None:
        found = found.withColumn("preview", F.concat("anomaly_id", F.lit(".png")))
        write_files(previews.patch_previews(shots, found.select(F.col("preview").alias("name"), F.col("source").alias("path"), "x", "y", "w", "h")), previews_at)
    if feedback is not None:
        keyed = found.withColumn("target_type", F.lit("anomaly")).withColumn("target_id", F.col("anomaly_id"))
        found = review.with_signal(keyed, feedback).drop("target_type", "target_id")
    held = images.profile(spark, path, tuple(pre["patch_sizes"]), tuple(pre["patch_strides"])).first().asDict(recursive=True)
    odd = {"files cannot be read as images": held["unreadable"], "files are of other kinds": held["unsupported"]}
    per_scale = {r.scale: r["count"] for r in p.groupBy("scale").count().collect()}  # a row a scale
    return report(
        run_id, "image", found.orderBy("rank"), concepts.orderBy("concept_id"), source=path, options=cfg, warnings=[f"{v} {k}" for k, v in odd.items() if v],
        dataset_summary=held,
        feature_summary={"patches": sum(per_scale.values()), "patches_by_scale": per_scale, "features": len(images.FEATURES), "scoring": d["novelty_strategy"]},
        score_summary=_scores(scored),
    )


def analyse_temporal(spark: SparkSession, manifest: str, folder: str, run_id: str = "run", strategy: str = "adjacent_difference", k: int = 10, sizes: tuple[int, ...] = (64,), strides: tuple[int, ...] = (64,)) -> dict:
    told, seen_at = json.loads(manifest), tables.temporal_manifest(manifest)
    obs = spark.createDataFrame(seen_at)
    shots = images.scan(spark, folder)
    own = F.expr("endswith(path, concat('/', source_path))")
    whole = images.patches(shots, (1 << 20,), (1 << 20,)).select("path", "v")  # one cropped patch: the whole image
    seen = cut(obs.join(whole, own).select(F.lit("sequence").alias("sequence"), "order_key", F.col("observation_id").alias("id"), "v"), "observations")
    events = cut(temporal.change_events(seen, strategy), "changes")
    adjacent = events if strategy == "adjacent_difference" else temporal.change_events(seen)
    groups = temporal.summary(events, adjacent)
    best = events.where(F.col("rank") <= k)
    parts = images.patches(shots, sizes, strides).join(obs, own).select(F.col("observation_id").alias("id"), "x", "y", "w", "h", "v")
    patches: dict[tuple, list] = {}
    for r in temporal.patch_evidence(parts, parts, best).orderBy("source_id", "target_id", "rank").collect():  # a few patches an event
        patches.setdefault((r.source_id, r.target_id), []).append({c: r[c] for c in ("x", "y", "w", "h", "score")})
    out = report(run_id, "temporal", best.orderBy("rank"), groups, source=folder, options={"strategy": strategy, "k": k, "sizes": list(sizes), "strides": list(strides)})
    ids = [o["observation_id"] for o in sorted(seen_at, key=lambda o: o["order_key"])]
    far = out["candidate_unknown_concepts"][0] if out["candidate_unknown_concepts"] else {}
    first = out["candidate_anomalies"][0] if out["candidate_anomalies"] else {}
    summary = {
        "sequence_id": str(told.get("sequence_id") or "sequence"), "dataset_name": str(told.get("dataset_name") or folder), "dataset_version": str(told.get("dataset_version") or "1"), "observation_count": len(ids),
        "ordering_mode": "timestamp" if "timestamp" in told["observations"][0] else "sequence_index", "range_start": str(min(o["order_key"] for o in seen_at)), "range_end": str(max(o["order_key"] for o in seen_at)), "strategy": strategy,
        "max_change_score": far.get("max_distance", 0.0), "mean_adjacent_change_score": far.get("mean_adjacent") or 0.0, "strongest_observation_pair": [first["source_id"], first["target_id"]] if first else ids[:2],
    }
    changes = [{"rank": r["rank"], "event_id": r["event_id"], "source_observation_id": r["source_id"], "target_observation_id": r["target_id"], "change_score": r["distance"], "patch_evidence": patches.get((r["source_id"], r["target_id"]), []), "requires_human_review": True} for r in out["candidate_anomalies"]]
    return {**out, "report_type": "temporal_visual_change", "sequence_summary": summary, "observation_ids": ids, "candidate_change_events": changes, "warnings": [], "limitations": ["Distances of features between pictures; light and framing change them too."]}


def _bullets(section: dict) -> list[str]:
    told = lambda v: ", ".join(f"{k}: {x}" for k, x in v.items()) if isinstance(v, dict) else ", ".join(map(str, v)) if isinstance(v, list) else v
    return [f"- {k.replace('_', ' ')}: {told(v) if v not in (None, [], {}) else 'none'}" for k, v in section.items()]


def _grid(rows: list[dict]) -> list[str]:
    if not rows:
        return []
    out = ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
    return out + ["| " + " | ".join(str(v).replace("|", "\\|") for v in row.values()) + " |" for row in rows]


def to_markdown(r: dict) -> str:
    lines = [f"# {r['modality']} findings of {r['run_id']}", "", "Candidates for human review; none is a confirmed fault.", ""]
    for key, title in SECTIONS.items():
        if r.get(key):
            lines += [f"## {title}", "", *(_grid(r[key]) if isinstance(r[key], list) else _bullets(r[key])), ""]
    lines += ["## Candidates", "", *_grid(r["candidate_anomalies"]), "", "## Groups", "", *_grid(r["candidate_unknown_concepts"]), ""]
    for title, key in (("Warnings", "warnings"), ("Limitations", "limitations"), ("Notes", "notes")):
        if r.get(key):
            lines += [f"## {title}", "", *[f"- {x}" for x in r[key]], ""]
    return "\n".join(lines)


def to_html(r: dict) -> str:
    text = lambda v: html.escape(str(v))

    def grid(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        head = "".join(f"<th>{text(k)}</th>" for k in rows[0])
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{text(v)}</td>" for v in row.values()) + "</tr>" for row in rows) + "</table>"

    def part(key: str, title: str) -> str:
        v = r.get(key)
        if not v:
            return ""
        inner = grid(v) if isinstance(v, list) and isinstance(v[0], dict) else "<ul>" + "".join(f"<li>{text(x)}</li>" for x in v) + "</ul>" if isinstance(v, list) else "<dl>" + "".join(f"<dt>{text(k)}</dt><dd>{text(x)}</dd>" for k, x in v.items()) + "</dl>"
        return f"<h2>{title}</h2>{inner}"

    middle = "".join(part(k, t) for k, t in SECTIONS.items())
    after = part("warnings", "Warnings") + part("limitations", "Limitations") + part("notes", "Notes")
    return f"<!doctype html><meta charset=utf-8><title>{text(r['run_id'])}</title><h1>{text(r['modality'])}</h1>{middle}<h2>Candidates</h2>{grid(r['candidate_anomalies'])}<h2>Groups</h2>{grid(r['candidate_unknown_concepts'])}{after}"


def publish_report(spark: SparkSession, r: dict, out: str, created_at: str) -> None:
    """Write a report as JSON, Markdown and HTML below `out`, and its run to the index there. A run is written once."""
    made = {"json": to_json(r), "md": to_markdown(r), "html": to_html(r)}
    write_files(spark.createDataFrame([(f"{r['run_id']}.{k}", bytearray(v.encode())) for k, v in made.items()], "name string, content binary"), out)
    run = (r["run_id"], created_at, r["modality"], f"{out}/{r['run_id']}.json", r["run_metadata"]["anomalies"], r["run_metadata"]["concepts"])
    runs.append_run(spark, run, f"{out}/index")


def to_json(r: dict) -> str:
    return json.dumps(r, indent=2, sort_keys=True, default=str)


def validate(r: dict) -> tuple[list[str], list[str]]:
    """(errors, warnings) about a report."""
    errors = [f"missing field: {f}" for f in REQUIRED if f not in r]
    if r.get("human_review_required") is not True:
        errors.append("human_review_required must be true")
    warnings = []
    for field, key in (("candidate_anomalies", "anomaly_id"), ("candidate_unknown_concepts", "concept_id")):
        rows = r.get(field)
        if rows is not None and not isinstance(rows, list):
            errors.append(f"{field} must be a list")
        elif r.get("modality") != "temporal":
            warnings += [f"{field}[{i}] has no {key}" for i, row in enumerate(rows or []) if not row.get(key)]
    ranks = [row["rank"] for row in r.get("candidate_anomalies") or [] if isinstance(row, dict) and "rank" in row]
    if ranks != sorted(ranks):
        errors.append("ranks are out of order")
    return errors, warnings


def averages(groups: DataFrame) -> DataFrame:
    """Mean confidence and consistency of the concepts of a run."""
    return groups.agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg("consistency"), 6).alias("mean_consistency"))


def last_runs(index: DataFrame, n: int) -> DataFrame:
    latest = index.orderBy(F.desc("created_at"), "run_id").limit(n)
    return latest.withColumn("n", F.row_number().over(Window.orderBy("created_at", F.desc("run_id")))).orderBy("n").drop("n")


def dashboard(index: DataFrame, feedback: DataFrame, n: int = 10, last: int = 25) -> dict:
    """The latest runs of the index, and of the reviews counts by label for each of these runs and its last n records."""
    shown = runs.listing(index.select(F.col("run_id").alias("name"), F.col("created_at").alias("modified")), last)
    of = shown.select(F.col("name").alias("run_id"))
    own = feedback.join(F.broadcast(of), "run_id", "left_semi")  # at most `last` rows
    records = runs.last_records(own, n).select("run_id", "position", "feedback_id", "target_type", "target_id", "label", "created_at")
    return {"runs": _rows(shown.orderBy("position")), "reviews": _rows(runs.label_rollup(own).orderBy("run_id")), "last_records": _rows(records.orderBy("run_id", "position"))}


def publish_dashboard(spark: SparkSession, held: dict, out: str, name: str = "dashboard") -> None:
    """Write a dashboard as JSON and HTML below `out`, once under a name."""
    page = {"run_id": name, "modality": "Dashboard", "candidate_anomalies": held["runs"], "candidate_unknown_concepts": held["reviews"]}
    text = to_html(page).replace("<h2>Candidates</h2>", "<h2>Runs</h2>").replace("<h2>Groups</h2>", "<h2>Reviews</h2>")
    made = {"json": json.dumps(held, indent=2, sort_keys=True, default=str), "html": text}
    write_files(spark.createDataFrame([(f"{name}.{k}", bytearray(v.encode())) for k, v in made.items()], "name string, content binary"), out)
