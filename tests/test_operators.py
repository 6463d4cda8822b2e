import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import scalars
from tidewater.operators import evaluation, images, profiling, reference, review, selection, tabular, temporal, timeseries, vectors
from tidewater.plans import config, discovery
from tidewater.sources import runs, tables


def global_gaps(df: DataFrame, ts: str, bucket: str = "day") -> DataFrame:
    """gap, in seconds, between neighbours in the order of time.

    Each bucket of time is ordered by itself; a window over one row for each bucket joins their ends, so no task holds
    the whole order.
    """
    t = df.select(F.col(ts).alias("t")).where("t is not null").withColumn("b", F.date_trunc(bucket, F.col("t").cast("timestamp")))
    seconds = lambda a, b: F.expr(f"timestampdiff(MICROSECOND, {a}, {b})") / 1e6
    inside = t.withColumn("p", F.lag("t").over(Window.partitionBy("b").orderBy("t"))).where("p is not null").select(seconds("p", "t").alias("gap"))
    ends = t.groupBy("b").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    across = ends.withColumn("p", F.lag("last").over(Window.orderBy("b"))).where("p is not null").select(seconds("p", "first").alias("gap"))
    return inside.union(across)


def values(spark, f, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i long, c string")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, v array<double>")


# --- scalars --------------------------------------------------------------------------------------------------------


def test_missing_and_numbers(spark):
    assert values(spark, scalars.is_missing, ["", " NA ", "n/a", "\tNaN\n", "null", "None", None, "0", "x"]) == [True] * 7 + [False] * 2
    assert values(spark, scalars.to_float, ["1", " -2.5e1 ", ".5", "3.", "1_000", "1.0d", "inf", "nan", "abc", "", None]) == [1.0, -25.0, 0.5, 3.0, 1000.0, None, None, None, None, None, None]


def test_timestamps(spark):
    got = values(spark, lambda c: scalars.parse_timestamp(c).cast("string"), ["2026-07-01", "2026-07-01T10:00:00Z", "2026-07-01 10:00:00", "07/01/2026", "07/01/2026 09:30:00", "2026", "junk", "2026-07-01T10:00:00+02:00"])
    assert got == ["2026-07-01 00:00:00", "2026-07-01 10:00:00", "2026-07-01 10:00:00", "2026-07-01 00:00:00", "2026-07-01 09:30:00", None, None, "2026-07-01 08:00:00"]


def test_small_functions(spark):
    assert values(spark, lambda c: scalars.clamp(c.cast("double")), ["-1", "0.5", "7", "NaN", None]) == [0.0, 0.5, 1.0, 0.0, 0.0]
    assert values(spark, scalars.relative_path, ["a\\b.png", "./x//y"]) == ["a/b.png", "x/y"]
    for bad in ("/etc/x", "a/../b", "C:\\x"):
        with pytest.raises(Exception, match="not a relative path"):
            values(spark, scalars.relative_path, [bad])
    assert values(spark, scalars.slug, ["A b/C!", "--x--"]) == ["a-b-c", "x"]
    assert values(spark, lambda c: scalars.min_max(c.cast("double"), F.lit(1.0), F.lit(1.0)), ["1"]) == [0.0]


# --- tables and profiles --------------------------------------------------------------------------------------------

CSV = "\ufeffparcel, grams ,carrier,remark\n" + "".join(f"{70 + i},{500 + 3 * i},{'road' if i % 2 else 'rail'},{'fragile' if i == 4 else ''}\n" for i in range(8)) + '90,99000,airship,"two\nlines, quoted"\n'


def test_csv_profile_and_roles(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text(CSV)
    df = tables.read_csv(spark, str(p))
    assert df.columns == ["parcel", "grams", "carrier", "remark", "row_index", "record_id"]
    assert [r.record_id for r in df.orderBy("row_index").collect()] == [f"row-{i:06d}" for i in range(1, 10)]
    assert profiling.roles(df, ["parcel", "grams", "carrier", "remark"]) == (["parcel", "grams"], ["carrier", "remark"])
    r = discovery.analyse_tabular(spark, str(p), options={"tabular": {"id_column": "parcel"}})
    assert r["candidate_anomalies"][0]["row_index"] == 9 and discovery.validate(r) == ([], [])
    assert "| rank |" in discovery.to_markdown(r) and "<table>" in discovery.to_html(r) and '"modality"' in discovery.to_json(r)


def test_csv_faults(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError, match="empty"):
        tables.read_csv(spark, str(tmp_path / "e.csv"))
    with pytest.raises(ValueError, match="csv"):
        tables.read_csv(spark, "x.txt")
    (tmp_path / "m.csv").write_text("a,b\n1,2,3\n4,5\n6\n")
    got = tables.read_csv(spark, str(tmp_path / "m.csv")).orderBy("row_index").collect()
    assert [(r.a, r.b) for r in got] == [("1", "2"), ("4", "5"), ("6", "")]
    assert tables.extra_field_rows(spark, str(tmp_path / "m.csv")).count() == 1


#: Seven readings of a well two hours apart, the fifth time twice and a day's rest before the last; and two without a time.
WELL = [(0, 3.1), (2, 3.2), (4, 3.1), (6, 3.3), (8, 9.9), (8, 9.9), (32, 3.2)]


def test_timeseries_file(spark, tmp_path):
    lines = [f"2025-03-{1 + h // 24:02d} {h % 24:02d}:30:00,north,{level},{12 + i % 2}" for i, (h, level) in enumerate(WELL)]
    (tmp_path / "t.csv").write_text("\n".join(["time,well,level,clearness", *lines, ",north,3,12", "yesterday,north,3,12"]))
    df = tables.read_timeseries_csv(spark, str(tmp_path / "t.csv"), entity="well")
    p = profiling.timeseries_profile(df, "ts", ["level", "clearness"], "entity").first()
    assert (p.row_count, p.valid_count, p.signal_count, p.entity_count) == (9, 7, 2, 1)
    assert profiling.duplicate_keys(df, "ts", "entity").first()[0] == 1 and profiling.baseline_gap(df, "ts") == 7200.0
    s = profiling.sampling_summary(df, "ts").first()
    assert (s.gap_count, s.min_gap, s.median_gap, s.max_gap, s.irregular) == (6, 0.0, 7200.0, 86400.0, True)
    f, names = timeseries.timeseries_features(df, "ts", "entity", ["level", "clearness"], "row_index")
    assert len(names) == 16 and [r.time_gap for r in f.orderBy("row_index").collect()] == [0.0] * 6 + [1.0]
    r = discovery.analyse_timeseries(spark, str(tmp_path / "t.csv"), options={"timeseries": {"entity_column": "well"}})
    assert r["candidate_anomalies"][0]["anomaly_id"] in ("ts-000005", "ts-000006", "ts-000007") and discovery.validate(r)[0] == []
    with pytest.raises(ValueError, match="Could not detect"):
        tables.time_column(["when", "value"])


def test_gaps_are_stitched_over_buckets(spark):
    rows = [(f"2026-01-0{d} {h:02d}:00:00",) for d in range(1, 5) for h in (1, 2, 9)]
    df = spark.createDataFrame(rows, "s string").select(F.col("s").cast("timestamp_ntz").alias("ts"))
    assert sorted(r.gap for r in global_gaps(df, "ts").collect()) == [3600.0] * 4 + [7 * 3600.0] * 4 + [16 * 3600.0] * 3


def test_missing_cells_and_reasons(spark):
    df = spark.createDataFrame([(i, str(i % 5), "a") for i in range(20)] + [(20, "NA", "a"), (21, "2", "zz"), (22, "50", "a")], "k long, n string, c string")
    got = {r.k: r.reason for r in tabular.tabular_novelty(df, "k", ["n"], ["c"], 3).collect()}
    assert got == {20: "missing_values", 21: "categorical_rarity", 22: "numeric_deviation"}
    assert tabular.reason_groups(tabular.tabular_novelty(df, "k", ["n"], ["c"], 3)).count() == 3


# --- vectors --------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    v = vecs(spark, [(2, (1, 0)), (1, (1, 0)), (3, (3, 0))])
    q = vecs(spark, [(9, (0, 0))])
    got = vectors.knn(q, v, 2).orderBy("rank").collect()
    assert [(r.id, r.distance, r.similarity) for r in got] == [(1, 1.0, 0.5), (2, 1.0, 0.5)]
    c = vectors.knn(vecs(spark, [(9, (1, 0))]), vecs(spark, [(1, (1, 0)), (2, (0, 1)), (3, (0, 0))]), 3, "cosine").orderBy("rank").collect()
    assert [(r.id, r.distance, r.similarity) for r in c] == [(1, 0.0, 1.0), (2, 1.0, 0.0), (3, 1.0, 0.0)]
    with pytest.raises(ValueError):
        vectors.knn(q, v, 0)


def test_blocks_do_not_change_neighbours(spark):
    rng = np.random.default_rng(0)
    v = vecs(spark, [(i, rng.normal(size=4)) for i in range(60)])
    a = vectors.knn(v, v, 3, exclude_self=True).orderBy("query_id", "rank").collect()
    assert a == vectors.knn(v, v, 3, exclude_self=True, block=7).orderBy("query_id", "rank").collect()


@pytest.mark.parametrize("strategy", sorted(vectors.STRATEGIES))
def test_outlier_comes_first(spark, strategy):
    v = vecs(spark, [(1, (0, 0)), (2, (0.1, 0)), (3, (10, 10)), (4, (0, 0.1)), (5, (0.1, 0.1))])
    assert vectors.candidates(vectors.novelty(v, strategy), 1).first().id == 3


def test_strategies_alone_and_unknown(spark):
    one = vecs(spark, [(1, (3, 4))])
    assert vectors.novelty(one, "hybrid").first().score == 0.0 and vectors.neighbour_distance(one).first().neighbour_id is None
    with pytest.raises(ValueError, match="hybrid"):
        vectors.novelty(one, "nope")


# --- reference, maps ------------------------------------------------------------------------------------------------


def test_reference_scores(spark):
    ref = vecs(spark, [(0, (0, 0)), (1, (2, 0)), (2, (0, 2))])
    assert reference.patch_scores(vecs(spark, [(9, (1, 0))]), ref).first().score == 1.0
    assert reference.patch_scores(vecs(spark, [(9, (0, 0))]), ref, k=3).first().score == pytest.approx(4 / 3, abs=1e-6)
    with pytest.raises(ValueError, match="both"):
        reference.check_compatible(ref, ref)
    with pytest.raises(ValueError, match="length"):
        reference.check_compatible(vecs(spark, [(9, (1, 0, 0))]), ref)
    reference.check_compatible(vecs(spark, [(9, (1, 0))]), ref)
    img = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "image_id long, id long, score double")
    assert reference.image_scores(img).first().score == 9 and reference.image_scores(img, "top_fraction_mean", 0.2).first().score == 8.5


def test_spatial_map(spark):
    p = spark.createDataFrame([(1, "s2", 0, 0, 2, 2, 2.0), (1, "s2", 1, 0, 2, 2, 4.0)], "image_id long, scale string, x int, y int, w int, h int, score double")
    m = reference.spatial_map(p)
    assert [r.value for r in m.where("py = 0").orderBy("px").collect()] == [2.0, 3.0, 4.0] and m.agg(F.sum("coverage")).first()[0] == 8
    two = p.union(spark.createDataFrame([(1, "s4", 0, 0, 1, 1, 4.0)], p.schema))
    assert [reference.spatial_map(two, "mean", a).where("px = 0 and py = 0").first().value for a in ("max", "mean")] == [4.0, 3.0]
    flat = spark.createDataFrame([(1, x, y, 5.0, 1) for x in range(3) for y in range(3) if x != 1 or y != 1], "image_id long, px int, py int, value double, coverage long")
    assert all(abs(r.value - 5) < 1e-9 for r in reference.smooth(flat, 1.0).collect()) and reference.display(flat).agg(F.max("shown")).first()[0] == 0.0


def test_coreset(spark):
    v = vecs(spark, [(1, (0,)), (2, (1,)), (3, (10,)), (4, (5,))])
    assert [r.id for r in reference.farthest_first(v, 1.0, 3).orderBy("position").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        reference.farthest_first(v, 1.0, 3, limit=2)


def test_coreset_of_many_vectors(spark):
    """More vectors than one task used to take, against a loop over all; few brought at once, so there are many passes."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(10_500, 3)), 1)  # with equal vectors and equal distances
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    at, want, far = 7, [], np.full(len(x), np.inf)
    for _ in range(40):
        want.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(1))
        far[at] = -1
        at = int(far.argmax())
    for ahead in (4, 1024):
        assert [r.id for r in reference.farthest_first(df, 0.1, 40, seed=7, ahead=ahead).orderBy("position").collect()] == want
    same = spark.createDataFrame([(i, [1.0]) for i in range(9)], "id long, v array<double>")
    assert [r.id for r in reference.farthest_first(same, 1.0, 9, seed=2, ahead=2).orderBy("position").collect()] == [2, 0, 1, 3, 4, 5, 6, 7, 8]


# --- calibration and evaluation -------------------------------------------------------------------------------------


def scores(spark, xs):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, score double")


def test_calibration(spark):
    fit = scores(spark, [0, 1, 2, 3])
    got = lambda xs, m: [r.calibrated for r in evaluation.calibrate(fit, scores(spark, xs), m).orderBy("id").collect()]
    assert got([-1, 0, 1.5, 3, 4], "empirical_percentile") == [0, 0.25, 0.5, 1, 1]
    assert got([-1, 1.5, 4], "minmax") == [0, 0.5, 1] and got([7], "identity") == [7]
    with pytest.raises(ValueError):
        got([1], "none")


def test_thresholds(spark):
    s = scores(spark, [0, 1, 2, 3]).withColumn("label", (F.col("id") >= 2).cast("int"))
    t = evaluation.threshold_candidates(s, {"two": 2.0, "four": 4.0}, (50.0,), (0.5,))
    assert {r.threshold_id: r.threshold for r in t.collect()} == {"explicit-two": 2.0, "explicit-four": 4.0, "percentile-50": 1.5, "top_fraction-0.5": 2.0}
    got = {r.threshold_id: r for r in evaluation.confusion(s, t).collect()}
    two, four = got["explicit-two"], got["explicit-four"]
    assert (two.tp, two.fp, two.tn, two.fn, two.precision, two.recall, two.f1) == (2, 0, 2, 0, 1.0, 1.0, 1.0) and four.precision is None
    half = s.withColumn("label", F.when(F.col("id") > 0, F.col("label")))
    assert evaluation.confusion(half, t).first().tp is None


def test_metrics(spark):
    s = spark.createDataFrame([(1, 0.1, 0), (2, 0.4, 0), (3, 0.9, 1), (4, 0.8, 1), (5, 0.7, None)], "id long, score double, label int")
    assert evaluation.auroc(s).first()[0] == 1.0 and evaluation.average_precision(s).first()[0] == 1.0
    assert {r.k: (r.precision, r.recall) for r in evaluation.at_k(s, (1, 3)).collect()} == {1: (1.0, 0.5), 3: (0.666667, 1.0)}
    tied = spark.createDataFrame([(1, 0.5, 0), (2, 0.5, 1), (3, 0.2, 0), (4, 0.9, 1)], "id long, score double, label int")
    assert evaluation.auroc(tied).first()[0] == 0.875
    ids = s.select("id")
    assert [r.id for r in evaluation.missing_predictions(ids, ids.where("id <> 4")).collect()] == [4]
    assert {r.strategy for r in evaluation.operating_points(s, 0.5, 90, 2, 0.4).collect()} == {"explicit", "percentile", "top_k", "top_fraction"}
    assert {r.gate: r.passed for r in evaluation.acceptance(evaluation.auroc(s), {"auroc": 0.8, "f1": 0.1}, {}).collect()} == {"min_auroc": True, "min_f1": False}
    assert evaluation.auroc(s.where("label = 1")).first()[0] is None


# --- change, review, selection --------------------------------------------------------------------------------------


def test_pairs(spark):
    obs = spark.createDataFrame([("s", i, i, [float(i * i), 0.0]) for i in range(3)], "sequence string, order_key int, id int, v array<double>")
    pairs = lambda m: sorted((r.source_id, r.target_id) for r in temporal.change_events(obs, m).collect())
    assert pairs("adjacent_difference") == [(0, 1), (1, 2)] and pairs("baseline_difference") == [(0, 1), (0, 2)]
    e = temporal.change_events(obs)
    assert e.where("rank = 1").first().target_id == 2 and e.first().event_id.startswith("change-")
    with pytest.raises(ValueError):
        temporal.change_events(obs, "x")


@pytest.mark.parametrize("labels, delta", [(["interesting", "important"], 2.0), (["false_positive", "not_useful"], -2.0), (["known_pattern", "duplicate", "needs_more_data"], -0.5), (["important", "needs_more_data"], 1.25)])
def test_review_signal(spark, labels, delta):
    f = spark.createDataFrame([("anomaly", "a1", x) for x in labels], "target_type string, target_id string, label string")
    t = spark.createDataFrame([("anomaly", "a1"), ("anomaly", "a2")], "target_type string, target_id string")
    assert {r.target_id: r.delta for r in review.with_signal(t, f).collect()} == {"a1": delta, "a2": 0.0}


def test_feedback_files(spark, tmp_path):
    f = spark.createDataFrame([("f1", "r1", "p", "anomaly", "a", "important", "", "me", "2026-01-01", None)], review.SCHEMA)
    runs.append_feedback(f, str(tmp_path / "fb"))
    runs.append_feedback(f, str(tmp_path / "fb"))
    assert runs.read_feedback(spark, str(tmp_path / "fb")).count() == 2
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"label": "important"}\nnot json\n')
    assert runs.read_feedback(spark, str(tmp_path / "bad"), strict=False).cache().where("malformed is not null").count() == 1
    with pytest.raises(Exception):
        runs.read_feedback(spark, str(tmp_path / "bad")).collect()
    index = spark.createDataFrame([("r1", "2026-01-01", 1), ("r2", "2026-01-02", 2)], "run_id string, created_at string, n int")
    new = spark.createDataFrame([("r1", "2026-01-03", 9)], "run_id string, created_at string, n int")
    up = runs.upsert(index, new)
    assert {r.run_id: r.n for r in up.collect()} == {"r1": 9, "r2": 2} and [r.run_id for r in discovery.last_runs(up, 1).collect()] == ["r1"]


def candidates(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, x int, y int, scale string, score double, v array<double>")


def test_diversity(spark):
    rows = [(1, "a", 0, 0, "s64", 9.0, [1.0]), (2, "a", 100, 0, "s64", 8.0, [1.0]), (3, "b", 0, 0, "s64", 7.0, [1.0])]
    pick = lambda r, **k: [x.id for x in selection.diverse(candidates(spark, r), 2, **k).orderBy("position").collect()]
    assert pick(rows, per_source=1) == [1, 3] and pick(rows) == [1, 2]
    assert pick([(1, "a", 0, 0, "s64", 9.0, [1.0]), (2, "a", 10, 0, "s64", 8.0, [1.0]), (3, "a", 50, 0, "s64", 7.0, [1.0])]) == [1, 3]
    assert pick([(1, "a", 0, 0, "s64", 9.0, [1.0]), (2, "b", 0, 0, "s64", 8.0, [1.0]), (3, "c", 0, 0, "s128", 1.0, [1.0])]) == [1, 3]


def test_diversity_of_scales(spark):
    """A scale whose best patch lies in an image with three better ones of another scale; centres; vectors apart."""
    schema = "id long, source string, x int, y int, w int, h int, scale string, score double, v array<double>"
    big = [(i, "a", 100 * i, 0, 64, 64, "s64", 10.0 - i, [float(i)]) for i in range(4)]
    rows = [*big, (10, "a", 1000, 0, 128, 128, "s128", 5.0, [50.0]), (11, "b", 0, 0, 128, 128, "s128", 1.0, [60.0]), (12, "b", 32, 32, 64, 64, "s64", 0.9, [61.0]), (13, "b", 100, 0, 64, 64, "s64", 0.8, [1.1])]
    pick = lambda **k: [r.id for r in selection.diverse(spark.createDataFrame(rows, schema), 10, **k).orderBy("position").collect()]
    assert pick() == pick(ahead=1) == [0, 10, 1, 11, 13]  # 12 has 11's centre
    assert pick(least_embedding=1.0) == pick(least_embedding=1.0, ahead=1) == [0, 10, 1, 11]
    assert pick(least_embedding=0.05) == [0, 10, 1, 11, 13]


def test_leader_clusters(spark):
    rows = [(1, "a", 0, 0, "s", 3.0, [1.0, 0.0]), (2, "b", 0, 0, "s", 2.0, [0.99, 0.05]), (3, "b", 0, 0, "s", 1.0, [0.0, 1.0])]
    c = selection.leader_clusters(candidates(spark, rows).withColumn("position", F.col("id").cast("int")), 0.35)
    assert {r.id: r.concept_id for r in c.collect()} == {1: "concept-0001", 2: "concept-0001", 3: "concept-0002"}
    s = {r.concept_id: r for r in selection.concept_scores(c).collect()}
    assert s["concept-0002"].consistency == 1.0 and all(0 <= r.confidence <= 1 for r in s.values())
    assert selection.evidence(c).where("concept_id = 'concept-0001'").first().representative == 1


# --- images ---------------------------------------------------------------------------------------------------------


def png(px: np.ndarray) -> bytes:
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w = px.shape[:2]
    raw = b"".join(b"\0" + px[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("img")
    rng = np.random.default_rng(1)
    for i in range(3):
        px = rng.integers(100, 120, (128, 128, 3)).astype(np.uint8)
        if i == 2:
            px[64:, 64:] = 255
        (d / f"i{i}.png").write_bytes(png(px))
    (d / "bad.png").write_bytes(b"nope")
    (d / "note.txt").write_text("x")
    (d / "small.ppm").write_bytes(b"P6 20 16 255\n" + bytes(20 * 16 * 3))
    return str(d)


def test_image_folder(spark, folder):
    p = images.profile(spark, folder).first()
    assert (p.files, p.images, p.unsupported, p.unreadable, p.estimated_patches, p.distinct_sizes) == (6, 4, 1, 1, 13, 2)
    got = images.patches(images.scan(spark, folder)).collect()
    assert len(got) == 13 and all(len(r.v) == 47 for r in got) and any(r.patch_id.endswith("small_s64_stride64_x0_y0") and (r.w, r.h) == (20, 16) for r in got)
    r = discovery.analyse_images(spark, folder, options={"discovery": {"max_candidate_anomalies": 4}})
    assert len(r["candidate_anomalies"]) == 4 and any("i2" in x["source"] for x in r["candidate_anomalies"][:2]) and discovery.validate(r) == ([], [])
    files = tables.fingerprints(spark, folder)
    assert files.count() == 6 and tables.dataset_fingerprint(files) == tables.dataset_fingerprint(files.orderBy(F.desc("path")))
    m = '{"observations": [{"observation_id": "o%d", "source_path": "i%d.png", "sequence_index": %d}, {"observation_id": "p", "source_path": "i2.png", "sequence_index": 5}]}' % (0, 0, 0)
    t = discovery.analyse_temporal(spark, m, folder)
    assert t["candidate_anomalies"][0]["target_id"] == "p" and discovery.validate(t)[0] == []


def test_features_and_labels():
    assert len(images.FEATURES) == 47
    f = dict(zip(images.FEATURES, images.features(np.full((4, 8, 3), 255, np.uint8))))
    assert f["aspect"] == 2 and f["mean"] == 1 and f["std"] == f["entropy"] == f["edge"] == 0 and f["hist_5"] == 1
    assert images.labels_of((64, 64, 32)) == ["s64", "s64_2", "s32"] and len(images.boxes(128, 128, 64, 64)) == 4


def test_manifests(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.temporal_manifest('{"observations": [{"observation_id": "a", "source_path": "../x", "sequence_index": 1}, {"observation_id": "b", "source_path": "y", "sequence_index": 2}]}')
    with pytest.raises(ValueError):
        tables.benchmark_manifest(spark, '{"samples": [{"sample_id": "a", "path": "p", "label": "odd"}]}')
    df = spark.range(3)
    tables.publish(df, str(tmp_path / "t"), {"v": 1})
    tables.publish(df, str(tmp_path / "t"), {"v": 1})
    assert tables.load_published(spark, str(tmp_path / "t"), {"v": 1}).count() == 3
    with pytest.raises(ValueError):
        tables.publish(df, str(tmp_path / "t"), {"v": 2})


def test_config():
    c = config.load({"preprocessing": {"patch_size": 32, "patch_stride": 16}})
    assert c["preprocessing"] == {"patch_sizes": [32], "patch_strides": [16]} and math.isclose(c["discovery"]["cluster_distance_threshold"], 0.35)
    for bad in ({"x": 1}, {"discovery": {"y": 1}}, {"discovery": {"novelty_strategy": "z"}}, {"preprocessing": {"patch_sizes": [0]}}):
        with pytest.raises(ValueError):
            config.load(bad)


def test_stream(spark, tmp_path):
    from tidewater.streaming.points import rolling_points

    src = tmp_path / "in"
    spark.createDataFrame([(1, i, f"2026-01-01 00:00:0{i}", v) for i, v in enumerate([1.0, 1.0, 9.0])], "entity long, event_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(src))
    stream = spark.readStream.schema("entity long, event_id long, ts timestamp, value double").parquet(str(src))
    q = rolling_points(stream, 1.0).writeStream.outputMode("append").format("memory").queryName("points").start()
    q.processAllAvailable()
    q.stop()
    assert [r.spike for r in spark.table("points").orderBy("event_id").collect()] == [False, False, True]


def test_orders(spark):
    from tidewater.operators import orders

    rng = np.random.default_rng(2)
    xs = sorted(set(rng.normal(size=500).tolist()))
    df = spark.createDataFrame([(x, i % 3) for i, x in enumerate(xs)], "x double, n int")
    got = orders.running(df, "x", ["n"], buckets=7).orderBy("x").collect()
    assert [r.n_before for r in got] == [sum(i % 3 for i in range(k)) for k in range(len(xs))] and {r.n_total for r in got} == {sum(i % 3 for i in range(len(xs)))}
    down = orders.running(df, "x", ["n"], descending=True, buckets=7).orderBy("x").collect()
    assert all(a.n_before + b.n_before + a.n == a.n_total for a, b in zip(got, down))
    assert [r.k for r in orders.numbered(df, "x", "k").orderBy("x").collect()] == list(range(1, len(xs) + 1))
    many = spark.createDataFrame([(g, float(v)) for g, n in ((0, 1), (1, 2), (2, 101), (3, 100)) for v in rng.integers(0, 20, n)], "g int, v double")
    want = {g: float(np.median([r.v for r in many.collect() if r.g == g])) for g in range(4)}
    assert {r.g: r.median for r in orders.medians(many, "g", "v", 8).collect()} == want


def test_leader_clusters_and_scores_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"s{i % 5}", 0, 0, "s", float(9 - i / 10), rng.normal(size=3).tolist()) for i in range(40)]
    means, sizes, name = [], [], {}
    for i, *_, v in rows:
        u = np.array(v) / np.linalg.norm(v)
        d = [np.linalg.norm(u - m) for m in means]
        if d and min(d) <= 0.6:
            at = int(np.argmin(d))
            means[at], sizes[at] = (means[at] * sizes[at] + u) / (sizes[at] + 1), sizes[at] + 1
        else:
            at = len(means)
            means.append(u)
            sizes.append(1)
        name[i] = f"concept-{at + 1:04d}"
    c = selection.leader_clusters(candidates(spark, rows).withColumn("position", F.col("id").cast("int")), 0.6)
    assert {r.id: r.concept_id for r in c.collect()} == name
    got = {r.concept_id: r for r in selection.concept_scores(c, 100).collect()}
    assert set(got) == set(name.values())
    for k, r in got.items():
        own = [x for x in rows if name[x[0]] == k]
        v, s = np.array([x[6] for x in own]), np.array([x[5] for x in own])
        parts = (s.mean() / max(s.max(), 1), min(len(own) / 5, 1), 1.0 if len(own) == 1 else 1 / (1 + np.linalg.norm(v - v.mean(0), axis=1).mean()), len({x[1] for x in own}) / len(own))
        assert (r.novelty, r.support, r.consistency, r.diversity) == pytest.approx(parts, abs=1e-6)
        assert r.confidence == pytest.approx(0.3 * parts[0] + 0.2 * parts[1] + 0.25 * parts[2] + 0.15 * parts[3] + 0.1, abs=1e-6)


def test_cosine_coreset_against_a_loop(spark):
    x = np.round(np.random.default_rng(8).normal(size=(200, 3)), 1)
    far, at, want = np.full(len(x), np.inf), 3, []
    for _ in range(20):
        want.append(at)
        far = np.minimum(far, np.round(1 - x @ x[at] / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(x[at]), 1e-300), 12))
        far[want] = -1
        at = int(far.argmax())
    got = reference.farthest_first(vecs(spark, enumerate(x.tolist())), 0.1, 20, seed=3, metric="cosine", ahead=8)
    assert [r.id for r in got.orderBy("position").collect()] == want


def test_smoothing_of_the_whole_image(spark):
    """A covered corner of a larger image: what lies beyond the cover weighs nothing."""
    rng = np.random.default_rng(5)
    m = spark.createDataFrame([(1, x, y, float(rng.normal()), 1) for x in range(2, 6) for y in range(3)], "image_id long, px int, py int, value double, coverage long")
    v = {(r.px, r.py): r.value for r in m.collect()}
    k = {d: math.exp(-d * d / 2) for d in range(-3, 4)}
    for r in reference.smooth(m, 1.0, spark.createDataFrame([(1, 8, 6)], "image_id long, width int, height int")).collect():
        near = [(k[a] * k[b], v.get((min(max(r.px + a, 0), 7), min(max(r.py + b, 0), 5)))) for a in k for b in k]
        assert r.value == pytest.approx(sum(w * x for w, x in near if x is not None) / sum(w for w, x in near if x is not None))


def test_metric_summary_warns(spark):
    rows = spark.createDataFrame([(1, 0, 0.5, True), (2, None, 0.5, False), (3, 1, None, None)], "id long, label int, score double, selected boolean")
    r = evaluation.metric_summary(rows).first()
    assert (r.samples, r.scored, r.labelled, r.unknown, r.selected, r.selected_fraction) == (3, 2, 2, 1, 1, 0.5)
    assert r.auroc is None and r.warnings == "missing_predictions,no_positive_labels,equal_scores"
    assert evaluation.metric_summary(rows.limit(0)).first().samples == 0


def test_confidence_passes_through_or_falls_back(spark):
    e = spark.createDataFrame([("a", 2.0, 10, 0.5, None), ("b", 4.0, 1, 1.0, None), ("c", 1.0, 1, 1.0, 0.25), ("d", 1.0, 1, 1.0, 3.0)], "concept_id string, average_novelty double, example_count long, consistency double, final_confidence double")
    assert {r.concept_id: r.confidence for r in selection.confidences(e).collect()} == {"a": 0.65, "b": 0.76, "c": 0.25, "d": 1.0}


def test_order_statistics_against_numpy(spark):
    import numpy as np
    from tidewater.operators.orders import order_statistics

    x = np.round(np.random.default_rng(5).normal(size=3000), 2)  # many ties
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    places = {f"{p}": (lambda n, p=p: (n - 1) * F.lit(p)) for p in (0.0, 0.1, 0.333, 0.5, 1.0)}
    got = order_statistics(df, "x", places)
    assert all(abs(got[k] - np.quantile(x, float(k))) < 1e-9 for k in places)
    assert order_statistics(df.where("x > 99"), "x", places) == dict.fromkeys(places)
    weighted = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 3)], "x double, w long")
    assert order_statistics(weighted, "x", {"m": lambda n: F.floor(n / 2)}, "w") == {"m": 1.0}


def test_gap_counts_are_the_gaps(spark):
    import random
    from datetime import datetime, timedelta
    from tidewater.operators import profiling

    r = random.Random(3)
    times = [datetime(2026, 1, 1) + timedelta(seconds=r.randrange(500)) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    from collections import Counter

    want = Counter(g.gap for g in global_gaps(df, "ts").collect())
    got = Counter()
    for g in profiling.gap_counts(df, "ts").collect():
        got[g.gap] += g.n
    assert got == want
    empty = profiling.sampling_summary(df.where("ts is null"), "ts").first()
    assert empty.gap_count == 0 and empty.median_gap is None and not empty.irregular


def test_rows_of_several_files_are_numbered_without_gaps(spark, tmp_path):
    from tidewater.sources.tables import read_csv

    folder = tmp_path / "parts.csv"
    folder.mkdir()
    for i in range(5):
        (folder / f"p{i}.csv").write_text("a,b\n" + "".join(f"{i},{j}\n" for j in range(i * 3)))
    rows = read_csv(spark, str(folder)).collect()
    assert sorted(r.row_index for r in rows) == list(range(1, 31)) and len({r.record_id for r in rows}) == 30


def test_switched_off_selection_records_and_whole_coreset(spark):
    from tidewater.operators import reference, selection
    from tidewater.sources import runs

    c = spark.createDataFrame([(3, 0.5, "s8"), (1, 0.9, None), (2, 0.5, "s4")], "id long, score double, scale string")
    assert [(r.position, r.id, r.reason) for r in selection.undiversified(c, 2).collect()] == [(1, 1, "high novelty"), (2, 2, "high novelty")]
    assert selection.scale_labels(c).first().scales == ["s4", "s8"]
    reports = spark.createDataFrame([("b", 2, "temporal"), ("a", 2, "visual"), ("c", 1, "visual")], "name string, modified long, type string")
    assert [r.name for r in runs.listing(reports).orderBy("position").collect()] == ["a", "b", "c"]
    history = spark.createDataFrame([("r1", 1), ("r2", 5)], "run_id string, created_at long")
    s = runs.summary(history, reports, c).first()
    assert (s.run_count, s.latest_run_id, s.report_count, s.temporal_report_count, s.latest_report_name, s.feedback_count) == (2, "r2", 3, 1, "a", 3)
    none = runs.summary(history.limit(0), reports.limit(0), c.limit(0)).first()
    assert (none.run_count, none.latest_run_id, none.temporal_report_count, none.latest_report_name) == (0, None, 0, None)
    assert reference.whole(c, 3).count() == 3
    with pytest.raises(ValueError):
        reference.whole(c, 2)


def test_series_without_entity_in_blocks(spark):
    """Blocks of two and of five rows give what one block gives; equal times, missing cells and an empty series, too."""
    rng = np.random.default_rng(6)
    rows = [(i, f"2025-05-01 00:{int(m):02d}:00", None if i % 7 == 3 else f"{x:.2f}") for i, (m, x) in enumerate(zip(rng.integers(0, 30, 60), rng.normal(size=60)))]
    df = spark.createDataFrame(rows, "k long, s string, a string").withColumn("ts", F.col("s").cast("timestamp_ntz"))
    get = lambda d, **kw: timeseries.timeseries_features(d, "ts", None, ["a"], "k", 3, 60.0, **kw)[0].orderBy("k").collect()
    want = get(df)
    assert [r.k for r in want] == list(range(60)) and want[0].asDict().keys() >= {"a:delta", "time_gap"}
    by = sorted(range(60), key=lambda i: (rows[i][1], i))
    x = [float(rows[i][2]) if rows[i][2] else None for i in by]
    sd = np.std([v for v in x if v is not None])
    for at, i in enumerate(by):
        last = [v for v in x[max(at - 2, 0) : at + 1] if v is not None]
        assert want[i]["a:delta"] == pytest.approx((x[at] - x[at - 1]) / sd if at and None not in (x[at], x[at - 1]) else 0)
        assert want[i]["a:rolling_mean_delta"] == pytest.approx((x[at] - np.mean(last)) / sd if x[at] is not None else 0)
    for block in (2, 5):
        for a, b in zip(get(df, block=block), want, strict=True):
            assert all(u == pytest.approx(v, abs=1e-9) if isinstance(v, float) else u == v for u, v in zip(a, b, strict=True))
    assert get(df.limit(0)) == []


def test_memory_of_images(spark, folder, tmp_path):
    from tidewater.plans import memory

    rng = np.random.default_rng(9)
    (tmp_path / "q").mkdir()
    for name, level in (("plain", 110), ("bright", 250)):
        (tmp_path / "q" / f"{name}.png").write_bytes(png((rng.integers(-5, 5, (64, 64, 3)) + level).astype(np.uint8)))
    out = str(tmp_path / "memory")
    m = memory.build(spark, folder, out, coreset="farthest_first", ratio=0.5)
    assert m["patches"] == 13 and m["vectors"] == 7 and memory.build(spark, folder, out, coreset="farthest_first", ratio=0.5) == m
    with pytest.raises(ValueError, match="another"):
        memory.build(spark, folder, out, most=20)
    with pytest.raises(ValueError, match="exceed"):
        memory.build(spark, folder, str(tmp_path / "m2"), most=5)
    images_of, patches_of, made = memory.score(spark, out, str(tmp_path / "q"))
    assert {r.path.rsplit("/", 1)[-1]: r.patches for r in images_of.collect()} == {"plain.png": 1, "bright.png": 1}
    assert made["scoring_id"] == memory.score(spark, out, str(tmp_path / "q"))[2]["scoring_id"] != memory.score(spark, out, str(tmp_path / "q"), k=2)[2]["scoring_id"]
    memory.publish_scores(patches_of, made, out)
    assert tables.load_published(spark, f"{out}/maps", {"scoring_id": made["scoring_id"]}).count() == 2 * 64 * 64
    with pytest.raises(ValueError, match="both roles"):
        memory.score(spark, out, folder)
    rows = spark.createDataFrame([(1, 0, 0.1, False), (2, 1, 0.9, True)], "id long, label int, score double, selected boolean")
    gates = memory.publish_evaluation(rows, out, {"auroc": 0.9}, {"selected_fraction": 0.2}, {"run": 1})
    assert {r.gate: r.passed for r in gates.collect()} == {"min_auroc": True, "max_selected_fraction": False}


def test_published_tables_are_verified_and_finished(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(f"{path}/data")  # what a broken run left
    with pytest.raises(ValueError, match="no finished"):
        tables.load_published(spark, path)
    df = spark.createDataFrame([(1, 0.5, None), (2, None, ["x"])], "a long, b double, `c d` array<string>")
    assert tables.publish(df, path, {"v": 1})["rows"] == 2 and tables.load_published(spark, path).count() == 2
    assert tables.digest(df) == tables.digest(df.orderBy(F.desc("a"))) != tables.digest(df.withColumn("b", F.lit(0.5)))
    df.limit(1).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="rows changed"):
        tables.load_published(spark, path)


def test_folder_of_inspected_parts(spark, tmp_path):
    def put(root, names):
        for name in names:
            (root / name).parent.mkdir(parents=True, exist_ok=True)
            (root / name).write_bytes(name.encode())
        return str(root)

    names = ["train/good/0.png", "train/good/1.png", "test/good/0.png", "test/dent/7.png", "ground_truth/dent/7_mask.png"]
    got = {r.path: (r.role, r.label, r.mask) for r in tables.labelled_folder(spark, put(tmp_path / "a", names)).collect()}
    assert got == {"train/good/0.png": ("reference", "normal", None), "train/good/1.png": ("reference", "normal", None), "test/good/0.png": ("query", "normal", None), "test/dent/7.png": ("query", "anomaly", "ground_truth/dent/7_mask.png")}
    with pytest.raises(ValueError, match="without"):
        tables.labelled_folder(spark, put(tmp_path / "b", names[:4]))
    with pytest.raises(ValueError, match="need images"):
        tables.labelled_folder(spark, put(tmp_path / "c", names[1:2] + names[3:]))
    put(tmp_path / "d", names)
    (tmp_path / "d/test/good/0.png").write_bytes(b"train/good/1.png")
    with pytest.raises(ValueError, match="both roles"):
        tables.labelled_folder(spark, str(tmp_path / "d"))


def test_benchmark_scores_a_labelled_split(spark):
    from tidewater.operators import reference

    memory = spark.createDataFrame([(100, [0.0, 0.0]), (101, [1.0, 0.0])], "id long, v array<double>")
    patches = spark.createDataFrame([(1, "p", [0.0, 0.0]), (2, "p", [0.0, 3.0]), (3, "q", [1.0, 0.0]), (4, "other", [9.0, 9.0])], "id long, image_id string, v array<double>")
    labels = spark.createDataFrame([("p", 1), ("q", 0), ("gone", 0)], "image_id string, label int")
    m = reference.benchmark(patches, memory, labels, 2.0).first()
    assert (m.samples, m.scored, m.anomalies, m.selected, m.high, m.auroc) == (3, 2, 1, 1, 3.0, 1.0) and m.warnings == "missing_predictions"
    with pytest.raises(ValueError):
        reference.benchmark(patches, memory.withColumn("id", F.col("id") - 99), labels, 2.0)
