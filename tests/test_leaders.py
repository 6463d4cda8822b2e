import numpy as np
import pytest

from tidewater.operators import leaders


def loop(x, threshold):
    """The loop of the definition, with sums in the order of the rows."""
    sums, sizes, out = np.zeros((0, x.shape[1])), np.zeros(0), []
    for v in x:
        u = v / (np.linalg.norm(v) or 1.0)
        d = np.sqrt(((sums / sizes[:, None] - u) ** 2).sum(1)) if len(sizes) else np.zeros(0)
        at = int(d.argmin()) if len(d) else -1
        if at < 0 or d[at] > threshold:
            at = len(sizes)
            sums, sizes = np.vstack([sums, np.zeros_like(u)]), np.append(sizes, 0.0)
        sums[at] += u
        sizes[at] += 1
        out.append(f"concept-{at + 1:04d}")
    return out


def run(spark, x, threshold, **more):
    rows = spark.createDataFrame([(3 * i + 5, i, v.tolist(), "clash") for i, v in enumerate(x)], "position int, id long, v array<double>, n string").repartition(5)
    got, rounds = leaders.clustered(rows, threshold, **more)
    assert got.columns == ["position", "id", "v", "n", "concept_id"]
    return [r.concept_id for r in got.orderBy("position").collect()], rounds


@pytest.mark.parametrize(("threshold", "late"), [(0.35, False), (0.6, True), (1.2, True)])
def test_same_as_the_loop(spark, threshold, late):
    """Blurred groups with many rows between two means; groups that come late found concepts in the middle of a batch."""
    rnd = np.random.default_rng(int(threshold * 100))
    c = rnd.normal(size=(14, 5))
    which = rnd.integers(14, size=6000)
    if late:
        which[:3000] %= 9
    x = c[which] + rnd.normal(size=(6000, 5)) * 0.3
    x[rnd.integers(6000, size=30)] = 0
    x[100:2500:3] = x[100]
    got, rounds = run(spark, x, threshold, first=200, undecided=600)
    assert got == loop(x, threshold)
    assert rounds.batches > 2


def test_most_rows_are_decided_in_parallel(spark):
    """A hundred thousand rows of tight groups."""
    rnd = np.random.default_rng(9)
    c = np.eye(8)
    x = c[rnd.integers(8, size=100_000)] + rnd.normal(size=(100_000, 8)) * 0.04
    got, rounds = run(spark, x, 0.35, first=2048, undecided=4096)
    assert got == loop(x, 0.35)
    assert rounds.alone < 20_000 and rounds.batches < 60


def test_few_rows_and_none(spark):
    x = np.array([[1.0, 0], [0.9, 0.1], [0, 1], [0, 0]])
    assert run(spark, x, 0.35, first=2048, undecided=10)[0] == loop(x, 0.35)
    none = spark.createDataFrame([], "position int, id long, v array<double>")
    assert leaders.leader_clusters(none).collect() == []


def test_rows_that_the_order_decides_take_few_batches(spark):
    """Means close together: hardly a row is certain, and a batch of bounded size for every few of them would not end."""
    x = np.random.default_rng(5).normal(size=(4000, 32))
    got, rounds = run(spark, x, 1.1, first=64, undecided=128)
    assert got == loop(x, 1.1)
    assert rounds.batches <= 10 and rounds.alone <= 4000
