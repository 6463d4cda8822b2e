import hashlib
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA, same_as_sql
from tidewater.llm import yinyang

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v array<int>"


def plain(rows, parts=16, entries=64, rounds=2):
    """The loop without bounds; rows are (vec_id, embedding, label)."""
    kept = [(i, [floor(256 * float(np.float32(x))) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([r[1] for r in kept], np.int64).reshape(len(kept), parts, -1)
    e = x[:entries].copy()  # entry, part, position

    def assign():
        d = ((x[:, None] - e[None]) ** 2).sum(3)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        at, _ = assign()
        for p in range(parts):
            for k in range(len(e)):
                own = x[at[:, p] == k, p]
                if len(own):
                    e[k, p] = own.sum(0) // len(own)
    at, d = assign()
    error = d.sum(1)
    labels = [r[2] for r in kept]
    sha = hashlib.sha256(",".join(str(c) for p in range(parts) for k in range(len(e)) for c in e[k, p]).encode()).hexdigest()
    return sorted(((str(r[0]), "".join(f"{k:02x}" for k in a), int(err), int(sum(q for q, l in zip(error, labels) if l == r[2])), sha) for r, a, err in zip(kept, at, error)))


def run(spark, rows, **more):
    d = spark.createDataFrame([(*r, "x", [1]) for r in rows], SCHEMA)
    return sorted((str(r.vec_id), *list(r)[1:]) for r in yinyang.encode(d, **more).collect())


@pytest.mark.parametrize("scale", [0.02, 0.3, 30.0])
def test_same_as_the_plain_loop(spark, scale):
    """Coarse values make many ties; large ones do not fit 16 bits of a bound."""
    rnd = np.random.default_rng(3)
    v = np.round(rnd.normal(size=(700, 32)) * scale, 2 if scale < 1 else 0)
    v[300:400] = v[5]
    rows = [(int(i), [float(x) for x in r], None if i % 5 == 0 else int(i % 3)) for i, r in zip(rnd.permutation(700), v)]
    assert run(spark, rows) == plain(rows)
    assert run(spark, rows, rounds=5, entries=100, parts=8, groups=3) == plain(rows, 8, 100, 5)


def test_part_takes_no_part(spark):
    v = [0.5, -0.5] * 8
    rows = [(1, v, 1), (1, v, 1), (None, [0.1] * 16, None), (2, None, 1), (3, [None] + v[1:], 1), (4, [float("nan")] * 16, 1), (5, [float("inf")] + v[1:], None), (0, v[::-1], None)]
    assert run(spark, rows) == plain(rows)
    odd = [(6, [], 1), (7, [1.0] * 15, 1), (8, [1.0] * 32, 1)]
    assert run(spark, rows + odd) == plain(rows)
    assert run(spark, rows[3:7]) == [] and run(spark, []) == []
    with pytest.raises(Exception, match="not coded exactly"):
        run(spark, [(1, [1e9] * 16, 1), (2, v, 1)])


def test_bounds_save_work(spark):
    state, _ = yinyang.fit(spark.read.parquet(str(DATA / "sf0.1/embeddings.parquet")))
    assert state.agg(F.avg("measured")).first()[0] < 0.6 * 16 * 64  # of all entries, in the last pass


def test_labels_beyond_the_broadcast(spark):
    rows = [(i, [float(i % 7), 1.0] * 8, i % 50) for i in range(300)]
    assert run(spark, rows, most_labels=10) == plain(rows)


def test_same_as_sql(spark):
    same_as_sql(spark, "op13_yinyang_codes", "sf0.01")
