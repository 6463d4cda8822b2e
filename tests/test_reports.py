import json

from tidewater.sources import reports

GOOD = {"project_name": "p", "run_id": "r", "run_metadata": {}, "candidate_anomalies": [{"anomaly_id": "a-1"}], "candidate_unknown_concepts": [], "human_review_required": True}
DIGEST = "0" * 64
SECTION = {"artifact_path": "x", "artifact_fingerprint": DIGEST, "requires_human_review": True}
CHANGE = {
    "report_type": "temporal_visual_change", "human_review_required": True, "observation_ids": ["o1", "o2"], "candidate_change_events": [{"rank": 1, "change_score": 0.5}, {"rank": 2, "change_score": 0}], "warnings": [], "limitations": ["few images"],
    "sequence_summary": {"sequence_id": "s", "dataset_name": "d", "dataset_version": "1", "range_start": "a", "range_end": "b", "ordering_mode": "timestamp", "strategy": "adjacent_difference", "max_change_score": 1, "mean_adjacent_change_score": 0.25, "observation_count": 2, "strongest_observation_pair": ["o1", "o2"]},
}


def check(spark, **files):
    rows = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in files.items()]
    return {r.path: r for r in reports.validate(spark.createDataFrame(rows, "path string, value string")).collect()}


def test_reports_of_findings(spark):
    got = check(
        spark,
        good=GOOD,
        broken="{not json",
        listed="[1]",
        empty="{}",
        kinds=GOOD | {"candidate_anomalies": {"a": 1}, "candidate_unknown_concepts": None, "review_memory_summary": [], "human_review_required": 1},
        ids=GOOD | {"candidate_anomalies": [{"anomaly_id": ""}, {"x": 1}, 5, {"anomaly_id": 0}], "candidate_unknown_concepts": [{"concept_id": "c"}, {"concept_id": None, "review_memory_signal": {"notes": "", "explanation": ""}}, {"concept_id": "d", "review_memory_signal": 3}]},
    )
    assert got["good"].is_valid and got["good"].errors == [] == got["good"].warnings and got["good"].report_type == "discovery"
    assert got["broken"].errors == ["Report is not valid JSON."] and got["listed"].errors == ["Report root must be a JSON object."] and got["broken"].report_type is None
    assert got["empty"].errors == [f"Missing required report field: {f}" for f in reports.REQUIRED] + ["human_review_required must be true."]
    assert got["kinds"].errors == ["human_review_required must be true.", "candidate_anomalies must be a list.", "review_memory_summary must be an object when present."]
    lacking = ", ".join(sorted(set(reports.SIGNAL) - {"notes", "explanation"}))
    assert got["ids"].is_valid and got["ids"].warnings == [
        "anomaly_id missing for item 1.", "anomaly_id missing for item 2.", "anomaly_id missing for item 4.", "concept_id missing for item 2.",
        f"review_memory_signal missing fields for item 2: {lacking}", "review_memory_signal must be an object for item 3.",
    ]


def test_sections_of_evidence(spark):
    got = check(
        spark,
        whole=GOOD | {"reference_scoring_summary": SECTION | {"calibrated": False, "candidate_count": 3}, "benchmark_validation_summary": SECTION | {"labels_available": True, "dataset_name": "d", "metrics": {"auroc": 0.5, "n": 3}}, "spatial_anomaly_map_summary": SECTION | {"preview_paths": ["a.PNG"]}},
        hollow=GOOD | {"calibration_summary": {}, "reference_scoring_summary": "no"},
        wrong=GOOD | {"calibration_summary": SECTION | {"artifact_path": " ", "artifact_fingerprint": "0" * 63 + "G", "requires_human_review": "yes", "calibrated": 1, "labels_available": True, "sample_count": -1}},
        more=GOOD | {"spatial_anomaly_map_summary": SECTION | {"preview_paths": ["a.png", "b.jpg"], "map_count": 1.5}, "benchmark_validation_summary": SECTION | {"labels_available": True, "metrics": {"auroc": None}}},
    )
    assert got["whole"].errors == []
    assert got["hollow"].errors == ["reference_scoring_summary must be a non-empty object when present.", "calibration_summary must be a non-empty object when present."]
    c = "calibration_summary."
    assert got["wrong"].errors == [c + x for x in ("artifact_path must be a non-empty string.", "artifact_fingerprint must be a lowercase SHA-256 digest.", "requires_human_review must be true.", "calibrated must be a boolean.", "sample_count must be a non-negative integer.")]
    assert got["more"].errors == ["spatial_anomaly_map_summary.map_count must be a non-negative integer.", "spatial_anomaly_map_summary.preview_paths must be a list of PNG paths.", "benchmark_validation_summary.dataset_name must be a non-empty string.", "benchmark_validation_summary.metrics must contain finite numeric values."]


def test_reports_of_change(spark):
    s = CHANGE["sequence_summary"]
    got = check(
        spark,
        good=CHANGE,
        ids=CHANGE | {"observation_ids": ["o1", "o1", "o2"]},
        few=CHANGE | {"observation_ids": ["o1"], "warnings": [1]},
        events=CHANGE | {"candidate_change_events": [{"rank": 2, "change_score": "high"}], "sequence_summary": s | {"strategy": "guess", "max_change_score": None, "strongest_observation_pair": ["o1", "o3"]}},
    )
    assert got["good"].errors == []
    assert got["ids"].errors == ["observation_ids must be unique.", "sequence_summary.observation_count must match observation_ids."]
    assert got["few"].errors == ["observation_ids must contain at least two non-empty strings.", "sequence_summary.strongest_observation_pair must reference observations.", "warnings must be a list of strings."]
    assert got["events"].errors == ["sequence_summary.strategy is unsupported.", "sequence_summary.max_change_score must be finite.", "sequence_summary.strongest_observation_pair must reference observations.", "candidate_change_events must be ranked from 1 without gaps.", "candidate_change_events need finite scores."]


def test_a_folder(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=2))
    (tmp_path / "b/c.json").write_text("{")
    (tmp_path / "note.txt").write_text("{}")
    got = {r.path.rsplit("/", 1)[-1]: r.is_valid for r in reports.validate(reports.read(spark, str(tmp_path))).collect()}
    assert got == {"a.json": True, "c.json": False}
