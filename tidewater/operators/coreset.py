"""Farthest-first coresets, with the distance of each vector to the nearest pick carried from pass to pass.

Vectors lie in a table of the shared folder, dealt to parts by the nearest of a few seeds, each with its distance to the
nearest pick so far. Of every part the driver holds the farthest vectors, a bounded number, and what the first vector
not held can be at most. Distances only shrink, so the farthest vector held is the next pick as long as no part can hide
a better one. Only parts that can are read again, their distances lowered by the picks made since they were last read
and, of those, by the ones that are near enough to lower any; all other parts stay as they lie. So the cost of a pass
depends on the parts it touches, not on how many picks there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop, new_path
from .neighbours import METRICS, distances, units_of

STATE = "own int, id long, v array<double>, far double"


def away(v: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances of vectors to one; squares of euclidean distances order as the distances do."""
    return ((v - x) ** 2).sum(1) if metric == "euclidean" else np.round(distances(x[None], v, metric)[0], 12)


def chords(v: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Distances that obey the triangle inequality, of vectors to one."""
    u = units_of(v, metric)[0]
    return np.sqrt(((u - units_of(x[None], metric)[0]) ** 2).sum(1))


class Parts:
    """The table of vectors in parts, and what the driver knows of each part."""

    def __init__(self, vectors: DataFrame, n: int, metric: str, ahead: int, parts: int | None):
        self.spark, self.metric, self.ahead = vectors.sparkSession, metric, ahead
        wanted = min(64, max(1, n // 1024)) if parts is None else parts
        sample = np.array([r.v for r in vectors.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(max(512, wanted)).collect()], float)
        seeds = [sample[0]]
        far = chords(sample, seeds[0], metric)
        while len(seeds) < wanted and far.max() > 0:
            seeds.append(sample[int(far.argmax())])
            far = np.minimum(far, chords(sample, seeds[-1], metric))
        self.seeds = np.stack(seeds)
        seeds, m = self.seeds, metric

        def deal(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in pieces:
                if len(p):
                    v = np.stack(p.v).astype(float)
                    own = np.stack([chords(v, s, m) for s in seeds]).argmin(0).astype(np.int32)
                    yield pd.DataFrame({"own": own, "id": p.id, "v": p.v, "far": np.inf, "part": own})

        path = new_path(self.spark, "coreset")
        vectors.select("id", "v").mapInPandas(deal, STATE + ", part int").write.partitionBy("part").parquet(path)

        def measure(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in pieces:
                for own, q in p.groupby("own"):
                    v = np.stack(q.v)
                    yield pd.DataFrame({"own": [own], "radius": [chords(v, seeds[own], m).max()], "n": [len(q)], "odd": [bool(units_of(v, m)[1].any())]})

        told = self.spark.read.schema(STATE).parquet(path).select("own", "v").mapInPandas(measure, "own int, radius double, n long, odd boolean")
        told = told.groupBy("own").agg(F.max("radius").alias("radius"), F.sum("n").alias("n"), F.max("odd").alias("odd")).collect()  # a row a part
        #: own -> path, radius (none where a vector has no direction) and number of vectors
        self.paths = {r.own: f"{path}/part={r.own}" for r in told}
        self.radius = {r.own: np.inf if r.odd else r.radius for r in told}
        self.count = {r.own: r.n for r in told}
        self.root = [path]
        #: own -> ids, vectors, distances of the farthest; the last one's (distance, id) when they were read; picks since.
        self.ids: dict[int, np.ndarray] = {}
        self.v: dict[int, np.ndarray] = {}
        self.far: dict[int, np.ndarray] = {}
        self.last: dict[int, tuple[float, int] | None] = dict.fromkeys(self.paths, (np.inf, -(1 << 63)))
        self.top: dict[int, float] = dict.fromkeys(self.paths, np.inf)
        self.since: dict[int, list[tuple[int, np.ndarray]]] = {own: [] for own in self.paths}
        self.reads = dict.fromkeys(self.paths, 0)

    def near(self, own: int, x: np.ndarray) -> bool:
        """Whether a pick can lower any distance in the part: the bound of the seed's ball against the largest of them."""
        if not np.isfinite(self.radius[own]) or not np.isfinite(self.top[own]) or units_of(x[None], self.metric)[1][0]:
            return True
        least = max(chords(self.seeds[own][None], x, self.metric)[0] - self.radius[own], 0.0) * (1 - 1e-9) - 1e-9
        return least <= np.sqrt(max(self.top[own], 0) * (1 if self.metric == "euclidean" else 2)) * (1 + 1e-9)

    def pick(self, i: int, x: np.ndarray) -> None:
        for own in self.paths:
            self.since[own].append((i, x))
            if own in self.ids and len(self.ids[own]):
                self.far[own] = np.minimum(self.far[own], away(self.v[own], x, self.metric))
                self.far[own][self.ids[own] == i] = -1.0

    def best(self) -> tuple[float, int, int, int] | None:
        """(distance, id, part, place) of the farthest vector held; equal ones by id."""
        found = None
        for own, far in self.far.items():
            if len(far):
                at = int(np.lexsort((self.ids[own], -far))[0])
                if far[at] >= 0 and (found is None or (-far[at], self.ids[own][at]) < (-found[0], found[1])):
                    found = (float(far[at]), int(self.ids[own][at]), own, at)
        return found

    def hiding(self, best: tuple[float, int, int, int] | None) -> list[int]:
        """Parts that may hold a vector not brought here that comes before the best."""
        return [own for own, last in self.last.items() if last is not None and (best is None or (-last[0], last[1]) < (-best[0], best[1]))]

    def read(self, parts: list[int]) -> None:
        """Bring the distances of these parts up to date and fetch their farthest vectors."""
        picked = {own: np.array([i for i, _ in self.since[own]], np.int64) for own in parts}
        close = {own: [x for i, x in self.since[own] if self.near(own, x)] for own in parts}
        metric, ahead = self.metric, self.ahead
        for own in parts:
            self.reads[own] += 1

        def lower(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in pieces:
                for own, q in p.groupby("own"):
                    v, far = np.stack(q.v), q.far.to_numpy(copy=True)
                    for x in close[own]:
                        far = np.minimum(far, away(v, x, metric))
                    far[np.isin(q.id, picked[own])] = -1.0
                    yield q.assign(far=far, part=own)

        def farthest(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, pd.DataFrame] = {}
            for p in pieces:
                for own, q in p[p.far >= 0].groupby("own"):
                    best[own] = pd.concat([best[own], q] if own in best else [q]).sort_values(["far", "id"], ascending=[False, True], kind="stable")[:ahead]
            yield from best.values()

        path = new_path(self.spark, "coreset")
        self.spark.read.schema(STATE).parquet(*[self.paths[own] for own in parts]).mapInPandas(lower, STATE + ", part int").write.partitionBy("part").parquet(path)
        drop(self.spark, [self.paths[own] for own in parts])
        self.root.append(path)
        self.paths.update({own: f"{path}/part={own}" for own in parts})
        # each task has at most `ahead` rows a part; ranks below the limit are sorted out before the shuffle and after it
        rows = self.spark.read.schema(STATE).parquet(path).mapInPandas(farthest, STATE)
        rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("far"), "id"))
        got: dict[int, list] = {}
        for x in rows.withColumn("rank", rank).where(F.col("rank") <= ahead).orderBy("own", "rank").collect():
            got.setdefault(x.own, []).append(x)
        for own in parts:
            r = got.get(own, [])
            self.ids[own], self.far[own] = np.array([x.id for x in r], np.int64), np.array([x.far for x in r])
            self.v[own] = np.array([x.v for x in r], float).reshape(len(r), self.seeds.shape[1])
            self.last[own] = (float(r[-1].far), int(r[-1].id)) if len(r) == ahead else None
            self.top[own] = float(r[0].far) if r else -1.0
            self.since[own] = []

    def close(self) -> None:
        drop(self.spark, self.root)


def farthest_first(vectors: DataFrame, ratio: float, most: int, seed: int = 0, limit: int | None = None, ahead: int = 256, metric: str = "euclidean", parts: int | None = None) -> DataFrame:
    """vector ids, which are unique, of a coreset by farthest-first traversal: order 0 is row seed % n by id, ties go to the smaller id.

    Distances are euclidean or cosine. `ahead` vectors a part are held on the driver. More than `limit` vectors raise
    ValueError if one is given; else there is no bound.
    """
    return traverse(vectors, ratio, most, seed, limit, ahead, metric, parts)[0]


def traverse(vectors: DataFrame, ratio: float, most: int, seed: int = 0, limit: int | None = None, ahead: int = 256, metric: str = "euclidean", parts: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """The coreset (id, position), and how often each part was read."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark, n = vectors.sparkSession, vectors.count()
    if limit is not None and n > limit:
        raise ValueError(f"{n} vectors exceed the limit of {limit}")
    target = min(most, n, int(np.ceil(n * ratio)))
    picked: list[int] = []
    reads: dict[int, int] = {}
    if target > 0:
        start = vectors.select("id", "v").orderBy("id").offset(seed % n).limit(1).first()
        table = Parts(vectors, n, metric, ahead, parts)
        try:
            picked.append(int(start.id))
            table.pick(int(start.id), np.asarray(start.v, float))
            while len(picked) < target:
                best = table.best()
                while hiding := table.hiding(best):
                    table.read(hiding)
                    best = table.best()
                if best is None:
                    break
                picked.append(best[1])
                table.pick(best[1], table.v[best[2]][best[3]])
        finally:
            table.close()
        reads = table.reads
    return spark.createDataFrame([(i, at) for at, i in enumerate(picked)], "id long, position int"), reads
