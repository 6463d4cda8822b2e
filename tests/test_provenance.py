import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewater import errors
from tidewater.operators import selection
from tidewater.sources import provenance, runs, tables


def test_equal_runs_have_one_digest_and_changed_inputs_are_named(spark, tmp_path):
    for i in range(3):
        (tmp_path / "in" / f"{i}").mkdir(parents=True)
        (tmp_path / "in" / f"{i}" / "p.json").write_text("".join(f'{{"id": {k}}}\n' for k in range(i + 1)))

    def run():
        return spark.read.schema("id long").option("recursiveFileLookup", True).json(str(tmp_path / "in")).where("id >= 0")

    config = {"k": 3}
    for content in (True, False):
        out = str(tmp_path / f"out{content}")
        a, b = provenance.publish(run(), out, config, content), provenance.publish(run(), out, config, content)
        assert a == b and a["rows"] == 6 and a["inputs"] == 3 and a["bytes"] > 0
        assert provenance.publish(run(), out + "-other", {"k": 4}, content)["digest"] != a["digest"]
        assert provenance.changes(spark, out, run()).count() == 0
    victim, gone = str(tmp_path / "in/1/p.json"), str(tmp_path / "in/0/p.json")
    with open(victim, "a") as f:
        f.write('{"id": 9}\n')
    os.rename(gone, str(tmp_path / "in/0/new.json"))
    for out in ("outTrue", "outFalse"):
        got = {r.path.split(":", 1)[1]: r.change for r in provenance.changes(spark, str(tmp_path / out), run()).collect()}
        assert got == {victim: "changed", gone: "missing", str(tmp_path / "in/0/new.json"): "new"}
        with pytest.raises(errors.IntegrityError, match="another table"):
            provenance.publish(run(), str(tmp_path / out), config, out == "outTrue")
    assert provenance.inputs(spark.range(3)).count() == 0


def test_a_manifest_and_its_files(spark, tmp_path):
    (tmp_path / "im").mkdir()
    sha = {}
    for name in ("a", "b", "c", "m"):
        (tmp_path / "im" / f"{name}.png").write_bytes(name.encode())
        sha[name] = hashlib.sha256(name.encode()).hexdigest()
    sample = lambda i, name, label="normal", **more: {"sample_id": i, "image_path": f"im/{name}.png", "label": label, "image_sha256": sha.get(name), **more}

    def put(*samples, **more):
        p = tmp_path / "manifest.json"
        p.write_text(json.dumps({"dataset_name": "d", "dataset_version": "1", "splits": [{"name": "test", "samples": list(samples)}]} | more, indent=1))
        return str(p)

    good = [sample("1", "a"), sample("2", "b", "anomaly", mask_path="im/m.png", mask_sha256=sha["m"])]
    got = tables.require_manifest(spark, put(*good), str(tmp_path)).collect()
    assert [(r.sample_id, r.split, r.label, r.mask_path) for r in got] == [("1", "test", "normal", None), ("2", "test", "anomaly", "im/m.png")]
    bad = [*good, sample("2", "c"), sample("4", "a"), sample("5", "gone"), sample("6", "c", image_sha256=sha["a"]), sample("7", "../x"), sample("8", "c", "odd", image_sha256="1"), sample(None, "b")]
    rows = {(r.sample_id, r.name, r.problem) for r in tables.check_manifest(spark, put(*bad), str(tmp_path)).collect()}
    assert {("5", "im/gone.png", "file is missing"), ("7", "im/../x.png", "path is not plain"), ("8", "odd", "unknown label"), ("8", "im/c.png", "not a digest"), (None, "im/b.png", "sample without an id"), ("2", "im/c.png", "id of another sample"), ("4", "im/a.png", "image of another sample")} <= rows
    with pytest.raises(errors.ManifestError, match="does not hold"):
        tables.require_manifest(spark, put(*bad), str(tmp_path))
    (tmp_path / "im/m.png").write_bytes(b"changed")
    assert [tuple(r) for r in tables.check_manifest(spark, put(*good), str(tmp_path)).collect()] == [("2", "im/m.png", "file is changed")]
    for odd in ({"splits": None}, {"dataset_name": " "}, {"splits": []}):
        with pytest.raises(errors.ManifestError):
            tables.require_manifest(spark, put(*good, **odd), str(tmp_path))


def test_last_records_and_label_counts(spark):
    rows = [(f"f{i:03d}", "hot" if i % 10 else "cold", runs.LABELS[i % 7], f"2024-01-{1 + i % 28:02d}") for i in range(300)]
    df = spark.createDataFrame(rows, "feedback_id string, run_id string, label string, created_at string")
    last = runs.last_records(df, 4)
    want = sorted([r for r in rows if r[1] == "hot"], key=lambda r: (-int(r[3][-2:]), r[0]))[:4]
    assert [r.feedback_id for r in last.where("run_id = 'hot'").orderBy("position").collect()] == [r[0] for r in want]
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()
    counts = {r.run_id: r for r in runs.label_rollup(df).collect()}
    assert counts["cold"].records == 30 and sum(counts["hot"][f"n_{x}"] for x in runs.LABELS) == 270


def test_absent_files_are_empty(spark, tmp_path):
    assert runs.read_index(spark, str(tmp_path / "index.json")).count() == 0 and runs.read_feedback(spark, str(tmp_path / "f.jsonl")).count() == 0
    with pytest.raises(ValueError, match="no such file"):
        tables.read_csv(spark, str(tmp_path / "no.csv"))
    with pytest.raises(ValueError, match="no such file"):
        tables.read_csv(spark, str(tmp_path / "no*.csv"))


def test_records_with_extra_fields(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n1,"two, quoted\nand, on, another, line"\n3,4,5\n6\n"7,7",8\n9,"x\ny",z\n')
    assert sorted(r.value for r in tables.extra_field_rows(spark, str(p)).collect()) == ["3,4,5", '9,"x\ny",z']


def test_evidence_with_near_matches(spark):
    rows = [(i, "c1" if i < 8 else "c2", f"s{i % 3}", float(i), [float(i), 0.0]) for i in range(12)]
    clustered = spark.createDataFrame(rows, "id long, concept_id string, source string, score double, v array<double>")
    memory = spark.createDataFrame([(100 + i, [i + 0.25, 0.0]) for i in range(20)] + [(3, [3.0, 0.0])], "id long, v array<double>")
    got = {r.concept_id: r for r in selection.evidence(clustered, 3, memory, 2).collect()}
    assert (got["c1"].representative, got["c1"].supporting, got["c1"].sources, got["c1"].size) == (7, [7, 6, 5], 3, 8)
    assert [tuple(x) for x in got["c2"].near_matches] == [(109, 9, 0.25), (110, 10, 0.25)]
    plan = selection.evidence(clustered, 3).select(F.size("supporting"))
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
