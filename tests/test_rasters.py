import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import rasters, reference

SCHEMA = "image_id string, scale string, x int, y int, w int, h int, score double"


def whole(patches, width, height, within, across, sigma):
    """One image at once."""
    layers, coverage = [], np.zeros((height, width), int)
    for scale in sorted({p[1] or "" for p in patches}):
        own = [p for p in patches if (p[1] or "") == scale]
        acc, n = np.full((height, width), 0.0 if within == "mean" else -np.inf), np.zeros((height, width), int)
        for _, _, x, y, w, h, s in own:
            area = np.s_[max(y, 0) : y + h, max(x, 0) : x + w]
            n[area] += 1
            acc[area] = acc[area] + s if within == "mean" else np.maximum(acc[area], s)
        layers.append(np.where(n > 0, acc / np.maximum(n, 1) if within == "mean" else acc, np.nan))
        coverage += n
    with np.errstate(all="ignore"):
        import warnings

        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            m = np.nanmean(layers, 0) if across == "mean" else np.nanmax(layers, 0)
    if sigma:
        k = rasters.kernel(sigma)
        r = len(k) // 2
        both = []
        for a in (np.nan_to_num(m), (~np.isnan(m)).astype(float)):
            for axis in (1, 0):
                pad = [(0, 0), (0, 0)]
                pad[axis] = (r, r)
                a = np.apply_along_axis(lambda row: np.convolve(row, k, "valid"), axis, np.pad(a, pad, mode="edge"))
            both.append(a)
        m = np.where(np.isnan(m), np.nan, both[0] / np.maximum(both[1], 1e-12))
    return m, coverage


@pytest.mark.parametrize(("within", "across", "sigma", "tile"), [("mean", "max", 0.0, 16), ("max", "mean", 1.3, 7), ("mean", "mean", 3.0, 5), ("mean", "max", 2.0, 64)])
def test_tiles_equal_the_whole_image(spark, within, across, sigma, tile):
    rnd = np.random.default_rng(4)
    patches = [(f"im/{i % 3}", [None, "s8", "s4"][int(rnd.integers(3))], int(rnd.integers(-3, 38)), int(rnd.integers(-3, 28)), int(rnd.integers(1, 12)), int(rnd.integers(1, 12)), float(np.round(rnd.normal(), 3))) for i in range(60)]
    patches += patches[:5] + [("im/0", "s8", 500, 5, 3, 3, 9.0), ("im/1", "s8", None, 5, 3, 3, 9.0), ("im/1", "s8", 5, 5, 3, 3, None), (None, "s8", 5, 5, 3, 3, 1.0)]
    sizes = spark.createDataFrame([(f"im/{i}", 40, 30) for i in range(3)], "image_id string, width int, height int")
    df = spark.createDataFrame(patches, SCHEMA).withColumn("value", F.lit("clash")).withColumn("tx", F.lit(1))
    m = rasters.smooth(rasters.draw(df, sizes, within, across, tile), sigma, tile)
    got = {(r.image_id, r.py, r.px): (r.value, r.coverage) for r in rasters.pixels(m, tile).collect()}
    seen = 0
    for i in range(3):
        own = [p for p in patches if p[0] == f"im/{i}" and p[2] is not None and p[6] is not None and p[2] < 40]
        value, coverage = whole(own, 40, 30, within, across, sigma)
        for y, x in zip(*np.nonzero(coverage)):
            v, c = got[f"im/{i}", y, x]
            assert abs(v - value[y, x]) < 1e-8 and c == coverage[y, x]
            seen += 1
    assert seen == len(got)


def test_a_very_wide_image_in_tiles(spark):
    """20,000 pixels wide: no task sees more than a tile and what lies on it."""
    patches = [("wide.png", "s", x, 0, 64, 48, float(x % 7)) for x in range(0, 20_000, 32)]
    sizes = spark.createDataFrame([("wide.png", 20_000, 50)], "image_id string, width int, height int")
    m = rasters.smooth(rasters.draw(spark.createDataFrame(patches, SCHEMA), sizes), 5.0)
    row = m.agg(F.count("*").alias("n"), F.max(F.size("value")).alias("most"), F.sum(F.size("value")).alias("all")).first()
    assert (row.n, row.most, row["all"]) == (79, 256 * 50, 20_000 * 50)
    share = rasters.coverage_share(m).first().covered
    assert abs(share - 48 / 50) < 1e-9
    shown = rasters.display(m).select(F.min(F.array_min("value")), F.max(F.array_max("value"))).first()
    assert tuple(shown) == (0.0, 1.0)


def test_empty_and_wrong(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rasters.pixels(rasters.smooth(rasters.draw(none), 1.0)).count() == 0
    with pytest.raises(ValueError, match="combined by"):
        rasters.draw(none, within="sum")
    with pytest.raises(ValueError, match="sigma"):
        rasters.smooth(rasters.draw(none), -1.0)


def test_smoothing_of_pixels_with_paths_as_ids(spark):
    flat = spark.createDataFrame([("a/b.png", x, y, 5.0, 1) for x in range(6) for y in range(4)], "image_id string, px int, py int, value double, coverage long")
    got = reference.smooth(flat, 1.0).collect()
    assert len(got) == 24 and all(abs(r.value - 5) < 1e-9 and r.image_id == "a/b.png" for r in got)


def test_patches_are_read_once_and_many_small_tiles_share_a_task(spark):
    """Scores of patches may cost a search; small tiles must not cost a pandas group each."""
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            read.add(len(p))
            yield p

    kind = "image_id long, scale string, x int, y int, w int, h int, score double"
    patches = spark.createDataFrame([(i // 4, "s", i % 4, 0, 2, 2, float(i)) for i in range(4000)], kind).mapInPandas(counted, kind)
    m = rasters.draw(patches, None, tile=3)
    assert "FlatMapGroupsInPandas" not in m._jdf.queryExecution().toString()
    got = {(r.image_id, r.px, r.py): (r.value, r.coverage) for r in rasters.pixels(m, 3).collect()}
    assert read.value == 4000
    assert len(got) == 1000 * 10
    for i in (0, 999):
        assert got[i, 0, 1] == (4.0 * i, 1) and got[i, 2, 0] == (4 * i + 1.5, 2) and got[i, 4, 1] == (4 * i + 3.0, 1)


def test_what_is_shown_is_drawn_once(spark):
    """A map that is scaled by its own ends is read twice; its tiles must not be drawn twice."""
    read = spark.sparkContext.accumulator(0)
    kind = "image_id long, px int, py int, value double, coverage long"

    def counted(parts):
        for p in parts:
            read.add(len(p))
            yield p

    pixels = spark.createDataFrame([(i // 5, i % 5, 0, float(i), 1) for i in range(500)], kind).mapInPandas(counted, kind)
    got = {(r.image_id, r.px): r.shown for r in reference.display(pixels).collect()}
    assert read.value == 500
    assert len(got) == 500 and all(v == px / 4 for (_, px), v in got.items())


def test_coverage_is_summed_up_in_one_pass(spark):
    """map_coverage draws its tiles once: one pass of Python over the boxes, and no join of what is drawn."""
    from tests.conftest import DATA
    from tidewater.plans import catalog

    plan = catalog.queries()["map_coverage"](spark, str(DATA / "sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
