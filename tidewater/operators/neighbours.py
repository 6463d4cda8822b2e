"""Exact nearest neighbours: in blocks, and past the blocks that the triangle inequality rules out.

Rows are placed by their nearest of a few pivots and, for each pivot, by rings of distance from it. Of every such unit the
least and the largest distance to each pivot are known, so a query has a lower bound on its distance to all rows of a
unit at once. It first looks at the units with the least bounds until they hold k rows; the distance of its k-th neighbour
so far then rules out all units whose bound is larger. What is left is searched, so no neighbour is lost. Pivots, rings
and bounds are bounded tables (at most 64 pivots and 512 units). Units lie together in shards of bounded size. A query
goes once to each shard that holds a unit it looks at, with the numbers of those units, and not once to each unit; a
task's group is a shard and a bounded part of its queries, measured as products of matrices in pieces of bounded size.

A bounded sample of the queries shows first how many pairs the bounds leave. Where that is most of them, the units are no
help, and every block of queries meets every block of rows, without a look at the bounds.

Cosine distances are half the square of the chord between unit vectors, which obeys the triangle inequality. Zero
vectors, at cosine distance 1 from everything, lie in a unit of their own that no bound rules out, and queries without
direction look at all units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import similarity
from ..sources.scratch import cut

METRICS = ("euclidean", "cosine")
FOUND = "query_id long, id long, distance double"
#: Distances are ranked after rounding to six places; a bound has to be larger by more than that to rule out a tie.
SLACK = 2e-6
#: Most rows of a shard, and most queries that meet it in one group; smaller inputs make at least FEW of each.
SHARD, FEW = 32768, 8
#: Least rows and queries of a block where vectors have several lengths or rows are few.
PLAIN = 4096
#: Distances that a task holds at once.
PIECE = 1 << 19
#: Rows that queries look at in one stretch, and at first, while they know no limit.
WIDE, NARROW = 2048, 128
#: Most rows and queries of a block where every block meets every other.
BLOCK = 65536
#: Queries that show how many pairs the bounds leave, and the share of pairs from which on blocks are cheaper.
SHOWN, SHARE = 1024, 0.25
#: Largest square of a length for which products are made in single precision.
SINGLE = 1e30


def distances(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of every query to every row; a zero vector is at cosine distance 1 from all."""
    if metric == "euclidean":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (r * r).sum(1) - 2 * q @ r.T, 0))
    a, b = np.linalg.norm(q, axis=1)[:, None], np.linalg.norm(r, axis=1)
    return 1 - np.where((a > 0) & (b > 0), q @ r.T / np.where(a * b > 0, a * b, 1), 0.0)


def exact(q: np.ndarray, r: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query to rows, without the cancellation of the product form."""
    return np.sqrt(((r - q) ** 2).sum(1)) if metric == "euclidean" else distances(q[None], r, metric)[0]


class Search:
    """Queries of one length against rows of that length, a stretch of rows at a time, in bounded pieces.

    A product of matrices finds what may be near enough, a little more than is; exact distances of those decide.
    """

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, k: int, metric: str, exclude_self: bool, same: bool, hidden: bool):
        self.k, self.metric, self.exclude_self, self.same = k, metric, exclude_self, same
        self.q, self.v = np.stack(left.qv).astype(float), np.stack(right.v).astype(float)
        self.qid, self.id = left.qid.to_numpy(), right.id.to_numpy()
        far = left.far.to_numpy(float) if "far" in left else np.full(len(left), np.nan)
        self.limit = np.where(np.isnan(far), np.inf, far + SLACK)
        if same:
            codes = pd.factorize(pd.concat([left.qs, right.s], ignore_index=True))[0]
            self.qs, self.s = codes[: len(left)], codes[len(left) :]
        self.gone: np.ndarray | None = None
        if hidden:
            ids, self.place = np.unique(self.id, return_inverse=True)
            pairs = [np.searchsorted(ids, g) + i * len(ids) for i, x in enumerate(left.qx) if x is not None and len(x) for g in (np.intersect1d(np.asarray(x), ids),)]
            self.distinct, self.gone = len(ids), np.concatenate(pairs) if pairs else np.zeros(0, np.int64)  # ascending
        if metric == "euclidean":
            self.aa, self.bb = (self.q * self.q).sum(1), (self.v * self.v).sum(1)
        else:
            self.a, self.b = self._factors(np.float64)
        largest = max(self.aa.max(), self.bb.max()) if metric == "euclidean" else max(np.abs(self.a).max(), np.abs(self.b).max())
        self._factor(np.float32 if largest < SINGLE else np.float64)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def _factors(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Matrices whose product is the square of the distance, or the distance by cosine."""
        one = lambda x: np.ones((len(x), 1))
        if self.metric == "euclidean":
            a, b = [-2 * self.q, self.aa[:, None], one(self.q)], [self.v, one(self.v), self.bb[:, None]]
        else:
            a, b = [-units_of(self.q, self.metric)[0], one(self.q)], [units_of(self.v, self.metric)[0], one(self.v)]
        return np.hstack(a, dtype=kind, casting="same_kind"), np.hstack(b, dtype=kind, casting="same_kind")

    def _factor(self, kind: type) -> None:
        """Products are made in single precision as long as its error, a bound on which is added, leaves few pairs."""
        self.kind, (self.left, self.right), self.room = kind, self._factors(kind), np.empty(PIECE, kind)  # one for all products
        self.slack = 1.2e-7 * (self.q.shape[1] + 10) if kind is np.float32 else 1e-12 * max(1.0, self.q.shape[1] / 1024)

    def barred(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs of a query and a row are no neighbours."""
        out = self.qid[i] == self.id[j] if self.exclude_self else np.zeros(len(i), bool)
        if self.same:
            out |= (self.qs[i] == self.s[j]) & (self.s[j] >= 0)
        if self.gone is not None and len(self.gone):
            pair = i * self.distinct + self.place[j]
            at = np.searchsorted(self.gone, pair)
            out |= self.gone[np.minimum(at, len(self.gone) - 1)] == pair
        return out

    def look(self, asking: np.ndarray, low: int, high: int) -> None:
        """Measure the queries of these places against the rows from low to high."""
        r, wide = low, WIDE if np.isfinite(self.limit[asking]).all() else NARROW
        while r < high:
            top = min(r + wide, high)
            step = max(1, PIECE // (top - r))
            for at in range(0, len(asking), step):
                self._piece(asking[at : at + step], r, top)
            if wide < WIDE:
                self.best()  # gives limits
                wide = min(2 * wide, WIDE)
            r = top

    def _piece(self, i: np.ndarray, low: int, high: int) -> None:
        d = self.room[: len(i) * (high - low)].reshape(len(i), -1)
        np.matmul(self.left[i], self.right[low:high].T, out=d)
        round_off = self.slack * (self.aa[i] + self.bb[low:high].max() if self.metric == "euclidean" else np.ones(len(i)))
        fresh = np.flatnonzero(~np.isfinite(self.limit[i]))  # nothing known yet: the k-th distance here is a limit
        if len(fresh) and high - low > self.k:
            own = d[fresh]
            x, y = np.nonzero(np.ones(own.shape, bool)) if self.same or self.exclude_self or self.gone is not None else (np.zeros(0, int),) * 2
            if len(x):
                bar = self.barred(i[fresh][x], low + y)
                own[x[bar], y[bar]] = np.inf
            kth = np.partition(own, self.k - 1, 1)[:, self.k - 1].astype(float)
            kth = np.where(np.isfinite(kth), kth + round_off[fresh], np.inf)
            self.limit[i[fresh]] = np.sqrt(np.maximum(kth, 0)) if self.metric == "euclidean" else kth
        limit = self.limit[i]
        limit = limit + 1e-6 * (2 + np.abs(limit))
        near = (limit * limit if self.metric == "euclidean" else limit) + round_off
        if self.kind is np.float32:  # all finite: a query's least distance tells whether there is any
            near = np.nextafter(near.astype(np.float32), np.float32(np.inf))
            some = np.flatnonzero(d.min(1) <= near)
            x, y = np.divmod(np.flatnonzero(d[some] <= near[some, None]), high - low)
            x = some[x]
            if len(x) > max(d.size // 16, 4 * self.k * len(i)) and len(fresh) < len(i):
                self._factor(np.float64)
                return self._piece(i, low, high)
        else:
            x, y = np.divmod(np.flatnonzero(d <= near[:, None]), high - low)
        if not len(x):
            return
        x, y = i[x], y + low
        keep = ~self.barred(x, y)
        x, y = x[keep], y[keep]
        e = np.empty(len(x))
        for at in range(0, len(x), 65536):
            p, q = x[at : at + 65536], y[at : at + 65536]
            if self.metric == "euclidean":
                e[at : at + 65536] = np.sqrt(((self.v[q] - self.q[p]) ** 2).sum(1))
            else:
                e[at : at + 65536] = np.einsum("ij,ij->i", self.a[p], self.b[q])
        good = np.isfinite(e)
        self.found.append((x[good], y[good], e[good]))
        self.held += int(good.sum())
        if self.held > max(65536, 4 * self.k * len(self.q)):
            self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's k nearest so far; their largest distance is its limit."""
        x, y, e = (np.concatenate([f[c] for f in self.found]) if self.found else np.zeros(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        order = np.lexsort((self.id[y], np.round(e, 6), x))
        x, y, e = x[order], y[order], e[order]
        first = np.searchsorted(x, x)
        keep = np.arange(len(x)) - first < self.k
        last = np.arange(len(x)) - first == self.k - 1
        self.limit[x[last]] = np.minimum(self.limit[x[last]], e[last] + 1e-6)
        self.found, self.held = [(x[keep], y[keep], e[keep])], 0
        return self.found[0]


def block_search(k: int, metric: str, exclude_self: bool, same: bool, hidden: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For queries (qid, qv, qs, qx) and rows (id, v, s): each query's k nearest rows, ties to the smaller id once
    distances are rounded to six places. Vectors of another length than the query's are no neighbours. With the columns
    `units` of queries and `unit` of rows a query looks at those units alone, with `far` at no row beyond it."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0)})]
        sizes = right.v.map(len) if len(right) else pd.Series(dtype=int)
        for dims, part in left.groupby(left.qv.map(len)) if len(left) else ():
            own = right[sizes == dims]
            if not len(own):
                continue
            if "unit" in own:
                own = own.sort_values("unit", kind="stable")
            search = Search(part, own, k, metric, exclude_self, same, hidden)
            if "unit" in own:
                unit = own.unit.to_numpy()
                edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
                asked = np.repeat(np.arange(len(part)), part.units.map(len))
                units = np.concatenate(list(part.units))
                order = np.argsort(units, kind="stable")
                asked, units = asked[order], units[order]
                for low, high in zip(edges, edges[1:]):
                    a, b = np.searchsorted(units, unit[low]), np.searchsorted(units, unit[low], "right")
                    if b > a:
                        search.look(asked[a:b], low, high)
            else:
                search.look(np.arange(len(part)), 0, len(own))
            x, y, e = search.best()
            out.append(pd.DataFrame({"query_id": search.qid[x], "id": search.id[y], "distance": e}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return nearest


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "id")
    near = found.withColumn("distance", F.round("distance", 6))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def many_blocks(n: int) -> int:
    """At least FEW blocks of rows, unless they are short, none of more than BLOCK."""
    return max(1, -(-n // min(BLOCK, max(PLAIN, -(-n // FEW)))))


def in_blocks(q: DataFrame, r: DataFrame, search: Callable, nq: int, nr: int) -> DataFrame:
    """Every block of queries with every block of rows."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq))).withColumn("rb", every(nr))
    r = r.withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(nr))).withColumn("qb", every(nq))
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(search, FOUND)


def packed(rows: DataFrame, block: str, n: int) -> DataFrame:
    """(block, ids, v) of (id, vector): vectors of one length by blocks, some thousand in a row as bytes."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ids, v = p.iloc[:, 0].to_numpy(np.int64), p.iloc[:, 1]
            for b, at in pd.Series(pd.util.hash_array(ids) % np.uint64(n)).groupby(pd.util.hash_array(ids) % np.uint64(n)).indices.items():
                yield pd.DataFrame({block: [int(b)], "ids": [ids[at].tobytes()], "v": [np.stack(v.iloc[at]).astype(float).tobytes()]})

    return rows.mapInPandas(run, f"{block} int, ids binary, v binary")


def in_packed_blocks(q: DataFrame, r: DataFrame, search: Callable, nq: int, nr: int) -> DataFrame:
    """Every block of queries (qid, qv) with every block of rows (id, v), of which no more than that is looked at."""
    n = max(2 * nq * nr, int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # given, as few bytes are much work
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = packed(q.select("qid", "qv"), "qb", nq).withColumn("rb", every(nr)).repartition(n, "qb", "rb")
    r = packed(r.select("id", "v"), "rb", nr).withColumn("qb", every(nq)).repartition(n, "qb", "rb")

    def opened(p: pd.DataFrame, id_: str, v: str, **other) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(p.ids), np.int64)
        return pd.DataFrame({id_: ids, v: list(np.frombuffer(b"".join(p.v)).reshape(len(ids), -1)), **other})

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "distance": np.zeros(0)})
        return search(opened(left, "qid", "qv", qs=None, qx=None), opened(right, "id", "v", s=None))

    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(nearest, FOUND)


def units_of(v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as they obey the triangle inequality, and which of them have no direction."""
    if metric == "euclidean":
        return v, np.zeros(len(v), bool)
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n > 0, n, 1)[:, None], n == 0


def to_pivots(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots], 1)


def sampled(rows: DataFrame, key: str, n: int, v: str = "v") -> np.ndarray:
    """Vectors of a bounded sample by a hash of the ids."""
    return np.array([r[0] for r in rows.orderBy(F.xxhash64(key), key).limit(n).select(v).collect()], float)


def far_apart(v: np.ndarray, n: int) -> np.ndarray:
    picks, far = [0], ((v - v[0]) ** 2).sum(1)
    while len(picks) < min(n, len(v)) and far.max() > 0:
        picks.append(int(far.argmax()))
        far = np.minimum(far, ((v - v[picks[-1]]) ** 2).sum(1))
    return v[picks]


def open_share(queries: DataFrame, rows: DataFrame, k: int, metric: str, search: Callable, pivots: int, rings: int = 8) -> float:
    """The share of pairs that units would leave to some queries of a sample, whose k-th distances are found among all rows,
    by units of a sample of the rows. Those are narrower than the units of all rows, so they promise rather too much."""
    few = queries.orderBy(F.xxhash64("qid"), "qid").limit(SHOWN).toPandas()

    def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield search(few, p)

    found = ranked(rows.mapInPandas(near, FOUND), k).groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
    far = found.where(F.col("n") >= k).toPandas().set_index("query_id").far.reindex(few.qid).fillna(np.inf).to_numpy(float)
    far = (far if metric == "euclidean" else np.sqrt(2 * np.maximum(far, 0))) + SLACK
    v = units_of(sampled(rows, "id", 4 * SHOWN), metric)[0]
    u = units_of(np.stack(few.qv).astype(float), metric)[0]
    p = far_apart(v[:SHOWN], pivots)
    away, asks = to_pivots(v, p), to_pivots(u, p)
    at, left = away.argmin(1), 0
    for c in range(len(p)):
        own = away[at == c]
        for ring in np.array_split(own[np.argsort(own[:, c])], rings):
            if len(ring):
                bound = np.maximum(asks - ring.max(0), ring.min(0) - asks).max(1)
                left += len(ring) * int((bound <= far).sum())
    return left / (len(u) * len(v))


class PivotIndex:
    """Rows (id, v, s) of one length, placed in units; the table of placed rows lies in the shared folder."""

    def __init__(self, rows: DataFrame, n: int, metric: str, block: int, pivots: int | None = None, rings: int = 8, sample: int = 1024):
        self.metric, self.block, self.rows = metric, block, n
        self.pivots = self._choose(rows, min(64, max(8, -(-n // block))) if pivots is None else pivots, sample)
        p, m = self.pivots, metric

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in parts:
                if len(b):
                    u, zero = units_of(np.stack(b.v), m)
                    d = to_pivots(u, p)
                    at = d.argmin(1)
                    yield b.assign(cluster=np.where(zero, -1, at).astype(np.int32), away=d[np.arange(len(b)), at])

        kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
        placed = cut(rows.mapInPandas(place, f"{kind}, cluster int, away double"), "placed")
        edges = placed.groupBy("cluster").agg(F.percentile_approx("away", [i / rings for i in range(1, rings)], 1000).alias("e"))
        self.edges = {r.cluster: sorted(set(r.e)) for r in edges.collect()}  # one row a pivot
        cuts = placed.sparkSession.createDataFrame(list(self.edges.items()), "cluster int, e array<double>")
        ring = F.size(F.filter("e", lambda x: x < F.col("away"))).cast("int")
        self.placed = placed.join(F.broadcast(cuts), "cluster").withColumn("ring", ring).drop("e", "away")

        def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: dict[tuple[int, int], list] = {}
            for b in parts:
                if not len(b):
                    continue
                d = to_pivots(units_of(np.stack(b.v), m)[0], p)
                for key, at in b.groupby(["cluster", "ring"]).indices.items():
                    low, high, n = seen.get(key, (np.inf, -np.inf, 0))
                    seen[key] = [np.minimum(low, d[at].min(0)), np.maximum(high, d[at].max(0)), n + len(at)]
            if seen:
                yield pd.DataFrame([(c, r, j, low[j], high[j], n if not j else 0) for (c, r), (low, high, n) in seen.items() for j in range(len(p))], columns=["cluster", "ring", "pivot", "low", "high", "n"])

        got = self.placed.select("v", "cluster", "ring").mapInPandas(ends, "cluster int, ring int, pivot int, low double, high double, n long")
        got = got.groupBy("cluster", "ring", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).toPandas()
        self.units = sorted({(int(c), int(r)) for c, r in zip(got.cluster, got.ring)})  # at most pivots * rings and one
        number = {u: i for i, u in enumerate(self.units)}
        at = [number[int(c), int(r)] for c, r in zip(got.cluster, got.ring)]
        self.low, self.high, self.n = np.zeros((len(number), len(p))), np.zeros((len(number), len(p))), np.zeros(len(number), int)
        pivot = got["pivot"].to_numpy()
        self.low[at, pivot], self.high[at, pivot] = got.low, got.high
        np.add.at(self.n, at, got.n)
        odd = [i for i, (c, _) in enumerate(self.units) if c < 0]
        self.low[odd], self.high[odd] = -np.inf, np.inf
        self._shards()
        #: Pairs of a query and a row that were measured, and all of them.
        self.measured, self.pairs = 0, 0

    def _choose(self, rows: DataFrame, n: int, sample: int) -> np.ndarray:
        """Far apart among a bounded sample by a hash of the ids."""
        return far_apart(units_of(sampled(rows, "id", max(sample, n)), self.metric)[0], n)

    def _bounds(self, v: np.ndarray) -> np.ndarray:
        """Lower bounds of queries against units."""
        u, zero = units_of(v, self.metric)
        d = to_pivots(u, self.pivots)
        out = np.zeros((len(v), len(self.units)))
        for j in range(len(self.pivots)):
            np.maximum(out, np.maximum(d[:, j, None] - self.high[:, j], self.low[:, j] - d[:, j, None]), out=out)
        out -= 1e-9 * (1 + d.max(1))[:, None]
        out[zero] = 0.0
        return out

    def _shards(self) -> None:
        """Deal the units, in their order, to shards; a unit of more rows than a shard holds takes several by a hash of the ids."""
        most = min(SHARD, max(self.block, -(-self.rows // FEW)))
        self.shard, self.pieces, self.shards, held = np.zeros(len(self.n), np.int32), np.ones(len(self.n), np.int32), 0, 0
        for u, n in enumerate(self.n):
            if held and held + n > most:
                self.shards, held = self.shards + 1, 0
            self.shard[u], self.pieces[u] = self.shards, max(1, -(-int(n) // most))
            held += int(n)
            if n > most:
                self.shards, held = self.shards + int(self.pieces[u]), 0
        self.shards += 1

    def _meet(self, queries: DataFrame, choose: Callable[[pd.DataFrame], np.ndarray], search: Callable) -> DataFrame:
        """queries with the units that `choose` opens to them, a matrix of booleans."""
        shard, pieces, n, kind = self.shard, self.pieces, self.n, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
        groups = sorted(set(zip(shard.tolist(), pieces.tolist())))
        members = [np.flatnonzero(shard == s) for s, _ in groups]

        def asking(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
            for at in range(0, len(b), 256):
                yield b.iloc[at : at + 256], choose(b.iloc[at : at + 256])

        def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, pairs = np.zeros(len(groups), np.int64), 0
            for b in parts:
                for _, open_ in asking(b):
                    total += [int(open_[:, m].any(1).sum()) for m in members]
                    pairs += int((open_ * n).sum())
            yield pd.DataFrame({"at": np.arange(len(groups)), "asks": total, "pairs": [pairs] + [0] * (len(groups) - 1)})

        def deal(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in parts:
                for q, open_ in asking(b):
                    for (s, p), m in zip(groups, members):
                        own = open_[:, m]
                        rows = np.flatnonzero(own.any(1))
                        if len(rows):
                            units = [m[x].astype(np.int32) for x in own[rows]]
                            yield pd.concat([q.iloc[rows].assign(shard=np.int32(s + i), units=units) for i in range(p)])

        asks = queries.mapInPandas(count, "at int, asks long, pairs long").groupBy("at").agg(F.sum("asks").alias("asks"), F.sum("pairs").alias("pairs")).collect()  # a row a shard
        self.measured += sum(r.pairs for r in asks)
        parts_of = {}
        for r in asks:
            if r.asks:
                most = min(SHARD, max(1024, -(-r.asks // FEW)))
                parts_of |= {groups[r["at"]][0] + i: -(-r.asks // most) for i in range(groups[r["at"]][1])}
        spark = queries.sparkSession
        plan = F.broadcast(spark.createDataFrame([(s, n) for s, n in sorted(parts_of.items())], "shard int, parts int"))
        table = F.broadcast(spark.createDataFrame([(c, r, u, int(shard[u]), int(pieces[u])) for u, (c, r) in enumerate(self.units)], "cluster int, ring int, unit int, first int, pieces int"))
        q = queries.mapInPandas(deal, f"{kind}, shard int, units array<int>").join(plan, "shard").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))
        r = self.placed.join(table, ["cluster", "ring"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("pieces"))).cast("int"))
        r = r.join(plan, "shard").withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["shard", "qb"]
        return q.select(*keys, *queries.columns, "units").groupBy(*keys).cogroup(r.select(*keys, "id", "v", "s", "unit").groupBy(*keys)).applyInPandas(search, FOUND)

    def search(self, queries: DataFrame, k: int, search: Callable) -> DataFrame:
        """FOUND of queries (qid, qv, qs, qx): at least each one's k nearest rows."""
        queries = cut(queries, "queries")
        self.pairs += queries.count() * self.rows
        bounds, n, metric = self._bounds_only(), self.n, self.metric

        def nearest_units(low: np.ndarray) -> np.ndarray:
            order = np.argsort(low, axis=1, kind="stable")
            take = np.minimum((np.cumsum(n[order], 1) < k + 1).sum(1) + 1, len(n))
            out = np.zeros(low.shape, bool)
            np.put_along_axis(out, order, np.arange(len(n)) < take[:, None], 1)
            return out

        def first(q: pd.DataFrame) -> np.ndarray:
            return nearest_units(bounds(np.stack(q.qv)))

        def others(q: pd.DataFrame) -> np.ndarray:
            low = bounds(np.stack(q.qv))
            far = q.far.fillna(np.inf).to_numpy() + SLACK
            return (low <= (far if metric == "euclidean" else np.sqrt(2 * np.maximum(far, 0)))[:, None]) & ~nearest_units(low)

        found = cut(self._meet(queries, first, search), "found")
        kth = ranked(found, k).groupBy("query_id").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        kth = kth.select(F.col("query_id").alias("qid"), F.when(F.col("n") >= k, F.col("far")).alias("far"))
        more = cut(queries.join(kth, "qid", "left").select(*queries.columns, "far"), "asking")
        return found.union(self._meet(more, others, search))

    def _bounds_only(self) -> Callable[[np.ndarray], np.ndarray]:
        """The bounds without what cannot be sent to tasks."""
        slim = object.__new__(PivotIndex)
        slim.metric, slim.pivots, slim.units, slim.low, slim.high = self.metric, self.pivots, self.units, self.low, self.high
        return slim._bounds


def sides(queries: DataFrame, rows: DataFrame, exclude_same: str | None, exclude_ids: str | None) -> tuple[DataFrame, DataFrame]:
    text = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    gone = F.col(exclude_ids).cast("array<long>") if exclude_ids else F.lit(None).cast("array<long>")
    return queries.select(F.col("id").alias("qid"), F.col("v").alias("qv"), text(exclude_same).alias("qs"), gone.alias("qx")), rows.select("id", "v", text(exclude_same).alias("s"))


def knn(queries: DataFrame, rows: DataFrame, k: int, metric: str = "euclidean", exclude_self: bool = False, block: int = 4096, exclude_same: str | None = None, exclude_ids: str | None = None) -> DataFrame:
    """query_id, id, distance, similarity, rank: each query's k nearest rows, ties to the smaller id.

    queries and rows hold id and v (array<double>). Rows of more than one block, all of one length, are searched through a
    PivotIndex; else every pair of blocks is searched, with the same result. Vectors of another length than the query's
    are no neighbours, nor are rows with the query's value in the column `exclude_same` (an image, say), nulls aside, or
    with an id in the query's array `exclude_ids`. Rows of one source, or of all but one, are had by a filter on `rows`.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if k < 1:
        raise ValueError("k must be 1 or more")
    q, r = sides(queries, rows, exclude_same, exclude_ids)
    search = block_search(k, metric, exclude_self, exclude_same is not None, exclude_ids is not None)
    size = lambda df, c: df.agg(F.count("*"), F.min(F.size(c)), F.max(F.size(c))).first()
    (nr, low, high), (nq, q_low, q_high) = size(r, "v"), size(q, "qv")
    if nr > block and nq and low == high == q_low == q_high and low > 0:
        pivots = min(64, max(8, -(-nr // block)))
        if nq > 4 * SHOWN and open_share(q, r, k, metric, search, pivots) > SHARE:
            meet = in_blocks if exclude_same or exclude_ids else in_packed_blocks
            found = meet(q, r, search, many_blocks(nq), many_blocks(nr))
        else:
            found = PivotIndex(r, nr, metric, block).search(q, k, search)
    else:
        found = in_blocks(q, r, search, max(1, -(-nq // max(block, PLAIN))), max(1, -(-nr // max(block, PLAIN))))
    return ranked(found, k).withColumn("similarity", F.round(similarity(F.col("distance"), metric), 6))
