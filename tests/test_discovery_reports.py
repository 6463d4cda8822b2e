import json

import numpy as np

from tidewater.operators import images, previews
from tidewater.plans import discovery
from tidewater.sources import reports, runs


def valid(spark, *made):
    rows = [(str(i), discovery.to_json(r)) for i, r in enumerate(made)]
    return [(r.is_valid, r.errors, r.warnings) for r in reports.validate(spark.createDataFrame(rows, "path string, value string")).orderBy("path").collect()]


def test_reports_of_tables_and_series(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,amount,city\n" + "\n".join(f"{i},{100 + i % 5},{'ab'[i % 2]}" for i in range(40)) + "\n90,,c|d\n91,5000,a,more\n")
    r = discovery.analyse_tabular(spark, str(p), "r1", {"tabular": {"id_column": "id", "max_categorical_cardinality": 2}})
    assert r["dataset_summary"]["rows"] == 42 and r["dataset_summary"]["missing_values"] == {"amount": 1} and r["dataset_summary"]["numeric_columns"] == ["amount"]
    assert r["warnings"] == ["1 rows have extra fields", "city has 3 values"] and r["score_summary"]["max"] == r["candidate_anomalies"][0]["score"]
    text = discovery.to_markdown(r)
    assert "## Dataset" in text and "| amount | 1 | 41 |" in text and "- city has 3 values" in text and "<dt>rows</dt><dd>42</dd>" in discovery.to_html(r)
    q = tmp_path / "s.csv"
    q.write_text("time,well,flow\n" + "\n".join(f"2024-01-01 00:{i:02d}:00,{'ab'[i % 2]},{i % 4}" for i in range(30)) + "\n2024-01-01 09:00:00,a,900\nnever,a,1\n2024-01-01 09:00:00,a,2\n")
    s = discovery.analyse_timeseries(spark, str(q), "r2", {"timeseries": {"entity_column": "well"}})
    assert s["dataset_summary"]["timestamp_column"] == "time" and s["dataset_summary"]["entities"] == 2 and s["profile"]["irregular"] and s["profile"]["duplicate_times"] == 1
    assert "1 rows have no readable time" in s["warnings"] and "1 rows repeat an entity's time" in s["warnings"]
    assert valid(spark, r, s) == [(True, [], [])] * 2
    out = str(tmp_path / "out")
    discovery.publish_report(spark, r, out, "2024-01-01T00:00:00")
    discovery.publish_report(spark, s, out, "2024-01-02T00:00:00")
    assert json.loads((tmp_path / "out/r1.json").read_text())["run_id"] == "r1" and (tmp_path / "out/r2.md").read_text().startswith("# timeseries findings of r2")
    assert [(x.run_id, x.modality, x.anomalies) for x in runs.read_index(spark, f"{out}/index").orderBy("run_id").collect()] == [("r1", "tabular", 10), ("r2", "timeseries", 10)]


def test_reports_of_images_and_change(spark, tmp_path):
    rnd = np.random.default_rng(5)
    (tmp_path / "im").mkdir()
    for i in range(3):
        px = rnd.integers(90, 110, (96, 96, 3)).astype(np.uint8)
        if i == 2:
            px[32:64, 32:64] = 250
        (tmp_path / "im" / f"i{i}.png").write_bytes(previews.png(px))
    (tmp_path / "im/bad.png").write_bytes(b"no")
    options = {"preprocessing": {"patch_sizes": [32], "patch_strides": [32]}, "discovery": {"max_candidate_anomalies": 3, "min_spatial_distance": 1.0}}
    r = discovery.analyse_images(spark, str(tmp_path / "im"), "r3", options, previews_at=str(tmp_path / "previews"))
    first = r["candidate_anomalies"][0]
    assert first["source"].endswith("i2.png") and (first["x"], first["y"]) == (32, 32) and r["feature_summary"]["patches_by_scale"] == {"s32": 27} and r["warnings"] == ["1 files cannot be read as images"]
    shown = images.decode((tmp_path / "previews" / first["preview"]).read_bytes())
    assert shown.shape == (32, 32, 3) and (shown == 250).all() and len(list((tmp_path / "previews").iterdir())) == 3
    manifest = json.dumps({"sequence_id": "s1", "dataset_name": "d", "dataset_version": "2", "observations": [{"observation_id": f"o{i}", "source_path": f"i{i}.png", "sequence_index": i} for i in range(3)]})
    t = discovery.analyse_temporal(spark, manifest, str(tmp_path / "im"), "r4", sizes=(32,), strides=(32,))
    top = t["candidate_change_events"][0]
    assert t["sequence_summary"]["strongest_observation_pair"] == ["o1", "o2"] and (top["patch_evidence"][0]["x"], top["patch_evidence"][0]["y"]) == (32, 32)
    assert valid(spark, r, t) == [(True, [], [])] * 2 and "## Sequence" in discovery.to_markdown(t)


def test_dashboard(spark, tmp_path):
    index = spark.createDataFrame([("r1", "2024-01-01", "tabular", "x", 1, 1), ("r2", "2024-01-03", "image", "y", 2, 0), ("r3", "2024-01-02", "image", "z", 2, 0)], runs.INDEX)
    rows = [(f"f{i}", f"r{1 + i % 3}", None, "anomaly", f"a{i}", "important" if i % 2 else "duplicate", None, None, f"2024-02-{i + 1:02d}", None) for i in range(20)]
    held = discovery.dashboard(index, spark.createDataFrame(rows, discovery.review.SCHEMA), n=2, last=2)
    assert [r["name"] for r in held["runs"]] == ["r2", "r3"] and [r["run_id"] for r in held["reviews"]] == ["r2", "r3"]
    assert [(r["run_id"], r["feedback_id"]) for r in held["last_records"]] == [("r2", "f19"), ("r2", "f16"), ("r3", "f17"), ("r3", "f14")]
    discovery.publish_dashboard(spark, held, str(tmp_path))
    assert json.loads((tmp_path / "dashboard.json").read_text())["runs"][0]["name"] == "r2" and "<h2>Reviews</h2>" in (tmp_path / "dashboard.html").read_text()
