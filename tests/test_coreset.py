import numpy as np
import pytest

from tidewater.operators import coreset


def loop(x, start, n, metric="euclidean"):
    far, at, picks = np.full(len(x), np.inf), start, []
    for _ in range(n):
        picks.append(at)
        far = np.minimum(far, coreset.away(x, x[at], metric))
        far[picks] = -1
        at = int(far.argmax())
    return picks


def run(spark, x, n, **more):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3)
    got, reads = coreset.traverse(df, 1.0, n, **more)
    return [r.id for r in got.orderBy("position").collect()], reads


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_clustered_vectors_in_parts(spark, metric):
    """A third of all vectors are equal, some have no direction."""
    rnd = np.random.default_rng(1)
    x = np.round(rnd.normal(size=(12, 6))[rnd.integers(12, size=900)] * 4 + rnd.normal(size=(900, 6)) * 0.2, 2)
    x[::3] = x[1]
    x[7:20] = 0
    got, _ = run(spark, x, 60, seed=11, ahead=8, parts=6, metric=metric)
    assert got == loop(x, 11, 60, metric)


def test_far_parts_are_not_read_again(spark):
    """Two thirds of the picks come from wide parts: the narrow ones lie still."""
    rnd = np.random.default_rng(2)
    centre = np.repeat(np.arange(8)[:, None] * 1000.0, 200, 0) + np.zeros((1, 3))
    width = np.where(np.arange(1600) // 200 < 2, 30.0, 0.1)
    x = centre + rnd.normal(size=(1600, 3)) * width[:, None]
    got, reads = run(spark, x, 40, seed=0, ahead=4, parts=8)
    assert got == loop(x, 0, 40)
    often = sorted(reads.values())
    assert often[5] <= 6 and often[-1] >= 10  # six parts lie still while two are read again and again


def test_every_vector_and_none(spark):
    x = np.round(np.random.default_rng(3).normal(size=(30, 2)), 0)
    assert run(spark, x, 99, ahead=3, parts=3)[0] == loop(x, 0, 30)
    assert run(spark, x, 0)[0] == []
    none = spark.createDataFrame([], "id long, v array<double>")
    assert coreset.farthest_first(none, 1.0, 5).count() == 0
    with pytest.raises(ValueError, match="metric"):
        coreset.farthest_first(none, 1.0, 5, metric="taxicab")
