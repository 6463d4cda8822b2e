import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import errors
from tidewater.operators import acceptance, images, previews, rasters
from tidewater.plans import artifacts, memory
from tidewater.sources import tables

BOX = "image_id string, scale string, x int, y int, w int, h int, score double"


def test_previews_of_maps_decode_to_the_map(spark):
    boxes = [("a", "s", x, y, 9, 9, float((x * 7 + y) % 23)) for x in range(0, 50, 5) for y in range(0, 20, 5)] + [("b", "s", 3, 33, 2, 2, 1.0)]
    sizes = spark.createDataFrame([("a", 61, 43), ("b", 10, 40)], "image_id string, width int, height int")
    tiles = rasters.draw(spark.createDataFrame(boxes, BOX), sizes, tile=8)
    got = {r.image_id: images.decode(bytes(r.content)) for r in previews.map_previews(tiles, 8).collect()}
    shown = {(r.image_id, r.py, r.px): r.value for r in rasters.pixels(rasters.display(tiles), 8).collect()}
    assert got["a"].shape == (43, 61, 3) and got["b"].shape == (40, 10, 3)
    for name, px in got.items():
        for y in range(px.shape[0]):
            for x in range(px.shape[1]):
                assert px[y, x, 0] == np.rint(shown.get((name, y, x), 0.0) * 255)


def test_checksums_of_joined_bands():
    import zlib

    rnd = np.random.default_rng(1)
    for n, m in ((0, 5), (1, 70_000), (66_000, 65_521), (3, 0)):
        a, b = rnd.bytes(n), rnd.bytes(m)
        assert previews.joined_adler(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


def test_previews_of_patches(spark):
    px = np.random.default_rng(2).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    shots = spark.createDataFrame([("x.png", previews.png(px)), ("broken.png", b"\x89PNG\r\n\x1a\nno")], "path string, content binary")
    chosen = spark.createDataFrame([("one", "x.png", 3, 4, 5, 6), ("border", "x.png", 28, 18, 9, 9), ("beyond", "x.png", 40, 0, 3, 3), ("no", "broken.png", 0, 0, 3, 3), ("lost", "y.png", 0, 0, 3, 3)], "name string, path string, x int, y int, w int, h int")
    got = {r.name: images.decode(bytes(r.content)) for r in previews.patch_previews(shots, chosen).collect()}
    assert set(got) == {"one", "border"}
    assert (got["one"] == px[4:10, 3:8]).all() and (got["border"] == px[18:, 28:]).all()


def test_files_are_verified(spark, tmp_path):
    for name, content in (("a/1", b"one"), ("2", b"two"), ("more", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    sha = lambda b: __import__("hashlib").sha256(b).hexdigest()
    want = spark.createDataFrame([("a/1", sha(b"one").upper()), ("2", sha(b"2")), ("gone", None), ("more", None)], "name string, sha256 string")
    got = {r.name: r.status for r in tables.verify_files(want, str(tmp_path)).collect()}
    assert got == {"a/1": "ok", "2": "changed", "gone": "missing", "more": "ok"}
    assert {r.status for r in tables.verify_files(want, str(tmp_path / "nowhere")).collect()} == {"missing"}
    assert [r.name for r in tables.verify_files(want.where("name <> 'more'"), str(tmp_path)).where("status = 'unexpected'").collect()] == ["more"]


def test_results_are_named_by_their_content(spark, tmp_path):
    df, out = spark.createDataFrame([(1, 0.5), (2, None)], "id long, distance double"), str(tmp_path)
    name = artifacts.publish_result(df, out, "temporal_change")
    assert sorted(map(tuple, artifacts.load_result(spark, out, name, "temporal_change").collect())) == [(1, 0.5), (2, None)]
    with pytest.raises(errors.IntegrityError, match="already") as e:
        artifacts.publish_result(df.orderBy(F.desc("id")), out, "temporal_change")
    assert e.value.to_dict() == {"code": "integrity_error", "message": "the result is published already", "context": {"id": name}}
    assert artifacts.publish_result(df, out, "calibration") != name
    with pytest.raises(errors.IntegrityError, match="identity"):
        artifacts.load_result(spark, out, name, "calibration")
    with pytest.raises(errors.ConfigurationError, match="kind"):
        artifacts.publish_result(df, out, "gossip")
    df.write.mode("append").parquet(f"{out}/{name}/data")
    with pytest.raises(errors.IntegrityError, match="rows changed"):
        artifacts.load_result(spark, out, name, "temporal_change")


def test_a_scoring_with_maps_and_previews(spark, tmp_path):
    rnd = np.random.default_rng(3)
    for role, level in (("ref", 100), ("q", 120)):
        (tmp_path / role).mkdir()
        for i in range(2):
            (tmp_path / role / f"{i}.png").write_bytes(previews.png((rnd.integers(0, 9, (70, 90, 3)) + level + 60 * (role == "q" and i)).astype(np.uint8)))
    out = str(tmp_path / "m")
    options = {"preprocessing": {"patch_sizes": [32], "patch_strides": [16]}, "reference_scoring": {"smoothing_sigma": 2.0, "map_projection": "overlap_max", "multi_scale_fusion": "mean", "neighbor_count": 2}, "calibration": {"method": "minmax"}}
    memory.build(spark, str(tmp_path / "ref"), out, (32,), (16,))
    with pytest.raises(errors.ConfigurationError, match="baseline"):
        memory.score_with(spark, out, str(tmp_path / "q"), out, options)
    base = spark.createDataFrame([("x", 0.0), ("y", 10.0)], "path string, score double")
    at = memory.score_with(spark, out, str(tmp_path / "q"), f"{out}/scorings", options, base)
    assert artifacts.validate_scoring(spark, at) == {"images": 2, "maps": 2, "previews": 2}
    shots = tables.load_published(spark, f"{at}/images")
    assert {r.path.rsplit("/", 1)[-1] for r in shots.collect()} == {"0.png", "1.png"} and shots.where("calibrated between 0 and 1").count() == 2
    assert {images.decode(open(f"{at}/png/{f}", "rb").read()).shape for f in os.listdir(f"{at}/png")} == {(70, 90, 3)}
    with pytest.raises(errors.IntegrityError, match="already"):
        memory.score_with(spark, out, str(tmp_path / "q"), f"{out}/scorings", options, base)
    victim = f"{at}/png/{sorted(os.listdir(f'{at}/png'))[0]}"
    open(victim, "ab").write(b"!")
    with pytest.raises(errors.IntegrityError, match="changed"):
        artifacts.validate_scoring(spark, at)


POLICY = {"dataset_name": "d", "dataset_version": "1", "split_name": "test", "min_auroc": 0.7, "max_missing_predictions": 0}


def test_policies(spark):
    points = [{"strategy": "top_k", "value": 2, "min_precision": 1.0, "min_recall": 0.9}, {"strategy": "explicit", "value": 0.5, "max_selected_fraction": 0.5}, {"strategy": "percentile", "value": 50.0, "min_recall": 1.0}, {"strategy": "top_fraction", "value": 0.2}]
    policy = POLICY | {"operating_points": points}
    assert acceptance.run_config(policy) == {"split_name": "test", "explicit": [0.5], "percentile": [50.0], "top_k": [2], "top_fraction": [0.2]}
    samples = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0), (5, 1), (6, None)], "id long, label int")
    scored = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.6), (4, 0.1), (5, 0.7)], "id long, score double")
    got = {r.check: (r.value, r.passed) for r in acceptance.accept(samples, scored, policy).collect()}
    assert got == {
        "min_auroc": (1.0, True), "max_missing_predictions": (1.0, False), "min_precision at top_k=2": (1.0, True), "min_recall at top_k=2": (0.666667, False),
        "max_selected_fraction at explicit=0.5": (0.8, False), "min_recall at percentile=50": (1.0, True),
    }
    for bad in ({"split_name": " "}, {"min_auroc": 2}, {"operating_points": [{"strategy": "best", "value": 1}]}, {"operating_points": [points[0], points[0]]}, {"operating_points": [{"strategy": "top_k", "value": 1.5}]}, {"more": 1}):
        with pytest.raises(errors.ConfigurationError):
            acceptance.run_config(POLICY | bad)
