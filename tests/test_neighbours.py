import numpy as np
import pandas as pd
import pytest

from tidewater.operators import neighbours
from tidewater.operators.vectors import knn

SCHEMA = "id long, v array<double>, source string"


def brute(queries, rows, k, metric, same=False, self_=False, gone=None):
    out = []
    for i, q, s in queries:
        near = []
        for j, v, t in rows:
            if len(v) != len(q) or (self_ and i == j) or (same and s is not None and s == t) or (gone and j in gone[i]):
                continue
            near.append((round(float(neighbours.exact(np.array(q), np.array([v]), metric)[0]), 6), j))
        out += [(i, j, d, n) for n, (d, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def clustered(n, dims=8, clusters=20, seed=0, spread=0.05):
    rnd = np.random.default_rng(seed)
    c = rnd.normal(size=(clusters, dims)) * 3
    v = c[rnd.integers(clusters, size=n)] + rnd.normal(size=(n, dims)) * spread
    return [(i, [float(x) for x in r], [None, "a", "b"][i % 3]) for i, r in enumerate(v)]


def got(df):
    return sorted((r.query_id, r.id, r.distance, r["rank"]) for r in df.collect())


def near_equal(a, b):
    assert [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    assert max((abs(x[2] - y[2]) for x, y in zip(a, b)), default=0) < 2e-6


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_same_as_all_pairs(spark, metric):
    rows = clustered(900)
    rows += [(1000 + i, rows[5][1], "a") for i in range(150)]  # a hot value: more copies than a block holds
    rows += [(2000 + i, [0.0] * 8, "b") for i in range(80)]
    queries = rows[::29] + [(3000, [0.0] * 8, None), (3001, [100.0] * 8, "a"), (3002, rows[5][1], None)]
    q, r = (spark.createDataFrame(x, SCHEMA) for x in (queries, rows))
    near_equal(got(knn(q, r, 4, metric, block=64, exclude_self=True)), brute(queries, rows, 4, metric, self_=True))
    near_equal(got(knn(q, r, 3, metric, block=50, exclude_same="source")), brute(queries, rows, 3, metric, same=True))


def test_excluded_ids(spark):
    rows = clustered(300, seed=3)
    gone = {i: [j for j in range(300) if (i + j) % 2] + [-5] for i, _, _ in rows[:9]}
    gone[4] = []
    gone[5] = None
    q = spark.createDataFrame([(i, v, gone[i]) for i, v, _ in rows[:9]], "id long, v array<double>, no array<int>")
    want = brute(rows[:9], rows, 6, "euclidean", gone={k: x or [] for k, x in gone.items()})
    for block in (40, 4096):
        near_equal(got(knn(q, spark.createDataFrame(rows, SCHEMA), 6, block=block, exclude_ids="no")), want)


def test_fewer_rows_than_asked_for_and_other_lengths(spark):
    rows = clustered(70, seed=2)
    q, r = spark.createDataFrame(rows[:3], SCHEMA), spark.createDataFrame(rows, SCHEMA)
    assert knn(q, r, 200, block=16).count() == 3 * 70
    odd = [*rows, (500, [1.0], None)]
    near_equal(got(knn(q, spark.createDataFrame(odd, SCHEMA), 5, block=16)), brute(rows[:3], odd, 5, "euclidean"))
    assert knn(q.limit(0), r, 5, block=16).count() == 0 and knn(q, r.limit(0), 5, block=16).count() == 0


def test_most_pairs_are_skipped_on_clustered_rows(spark):
    rows = spark.createDataFrame(clustered(6000, seed=7), SCHEMA)
    q, r = neighbours.sides(rows.where("id % 10 = 0"), rows, None, None)
    index = neighbours.PivotIndex(r, 6000, "euclidean", 128)
    found = index.search(q, 5, neighbours.block_search(5, "euclidean", False, False, False))
    assert found.select("query_id").distinct().count() == 600
    assert index.measured <= 0.1 * index.pairs, index.measured / index.pairs


def test_a_query_goes_once_to_a_shard(spark, monkeypatch):
    """Not once to each unit: with 64-row blocks queries and lists of excluded ids would be copied hundreds of times."""
    monkeypatch.setattr(neighbours, "SHARD", 1024)
    rnd = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v], ["a", "b", None][i % 3]) for i, v in enumerate(rnd.normal(size=(3000, 16)))]
    rows[7:1307] = [(i, rows[7][1], "b") for i in range(7, 1307)]  # a unit of more rows than a shard holds
    queries = rows[::50]
    q, r = (spark.createDataFrame(x, SCHEMA) for x in (queries, rows))
    near_equal(got(knn(q, r, 5, block=64, exclude_self=True, exclude_same="source")), brute(queries, rows, 5, "euclidean", same=True, self_=True))
    seen = []
    plain = neighbours.block_search(3, "cosine", False, False, False)
    sides = neighbours.sides(q, r, None, None)
    index = neighbours.PivotIndex(sides[1], 3000, "cosine", 64)
    dealt = spark.sparkContext.accumulator(0)

    def counted(left, right):
        dealt.add(len(left))
        return plain(left, right)

    seen = index.search(sides[0], 3, counted)
    assert seen.select("query_id").distinct().count() == len(queries)
    assert index.shards < len(index.units) / 4
    assert dealt.value <= 4 * len(queries) * index.shards  # two looks, and a look may run twice


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_blocks_where_bounds_leave_most_pairs(spark, metric, monkeypatch):
    """Directions all over: no units are made, and bytes of blocks give what all pairs give."""
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in v], None) for i, v in enumerate(rnd.normal(size=(700, 24)))]
    rows += [(1000 + i, rows[i][1], None) for i in range(0, 60, 2)] + [(2000, [0.0] * 24, None)]
    for name, value in (("SHOWN", 64), ("PLAIN", 64), ("FEW", 3), ("PivotIndex", None)):
        monkeypatch.setattr(neighbours, name, value)
    df = spark.createDataFrame(rows, SCHEMA)
    near_equal(got(knn(df, df, 2, metric, exclude_self=True, block=64)), brute(rows, rows, 2, metric, self_=True))


def test_close_rows_far_from_the_origin():
    """Distances below what a product in single precision tells."""
    rnd = np.random.default_rng(6)
    v = 1e4 + rnd.normal(size=(600, 8))
    left = pd.DataFrame({"qid": np.arange(600), "qv": list(v), "qs": None, "qx": None})
    right = pd.DataFrame({"id": np.arange(600), "v": list(v), "s": None})
    found = neighbours.block_search(3, "euclidean", True, False, False)(left, right).sort_values(["query_id", "distance", "id"])
    d = np.sqrt(((v[:, None] - v) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert found.id.tolist() == np.argsort(d, 1)[:, :3].ravel().tolist()
    assert np.allclose(found.distance, np.sort(d, 1)[:, :3].ravel())


def test_scores_search_once(spark):
    from tidewater.operators import selection, vectors

    rows = spark.createDataFrame(clustered(200), SCHEMA)
    scored = vectors.novelty(rows, "hybrid")
    assert "CoGroups" not in scored._jdf.queryExecution().toString()
    s = scored.join(rows, "id").selectExpr("id", "source", "0 AS x", "0 AS y", "'s' AS scale", "score", "v")
    picked = selection.diverse(s, 5)
    assert "Pandas" not in picked._jdf.queryExecution().toString() and picked.count() == 3  # one a source, as all lie in one place
