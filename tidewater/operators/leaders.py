"""Leader clustering of any number of rows, equal to the loop over them in order.

In order, each unit vector joins the nearest running mean within a threshold, the first of equal ones, or founds a
concept. The rows go through in batches. In a batch all rows are measured against the means as they stand, in parallel.
How far a mean can move in the batch is bounded by the rows near enough to join it, so most rows have only one mean they
can join whatever the others do; these are certain. (Rows next to a mean that can move far, as one of few rows can, are not.) The others are taken to the driver in order, a bounded number, with
the sums of the certain rows that come between two of them, and are decided there as the loop would. Rows near one that
may found a concept are not certain either. If a new or small concept moves further than was allowed for, the batch ends there
and the rest is measured again. So no decision is taken on a guess, and a batch costs a few passes over its own rows.

Where means lie close together or move far, few rows are certain and the order decides most of them. Then stretches of
rows are decided in order without those passes, as many at once as were decided before, up to a bounded number, and a batch
is tried again whenever the rows decided have doubled. So the number of batches grows with the logarithm of the rows, and
beyond the bound with the rows by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop, new_path
from .orders import numbered


#: Bytes of vectors, and rows, that are on the driver at once at most where the order decides most rows.
HELD, MOST = 1 << 25, 1 << 16


def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n > 0, n, 1)[:, None]


def to_means(u: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Distances of vectors to means, by the difference: close ones must not be lost to cancellation."""
    if not len(means):
        return np.full((len(u), 0), np.inf)
    return np.stack([np.sqrt(((u - m) ** 2).sum(1)) for m in means], 1)


class Concepts:
    """Running sums and sizes in the order of founding."""

    def __init__(self, dims: int):
        self.n, self._sums, self._sizes, self._means = 0, np.zeros((64, dims)), np.zeros(64), np.zeros((64, dims))

    @property
    def sums(self) -> np.ndarray:
        return self._sums[: self.n]

    @property
    def sizes(self) -> np.ndarray:
        return self._sizes[: self.n]

    def means(self) -> np.ndarray:
        return self._means[: self.n].copy()

    def take(self, u: np.ndarray, threshold: float) -> tuple[int, bool]:
        """One step of the loop: the concept joined, and whether it is a new one."""
        away = self._means[: self.n] - u
        d = np.sqrt((away * away).sum(1))
        at = int(np.argmin(d)) if len(d) else -1
        if at >= 0 and d[at] <= threshold:
            self.add(at, u, 1)
            return at, False
        if self.n == len(self._sizes):
            self._sums, self._means = (np.vstack([x, np.zeros_like(x)]) for x in (self._sums, self._means))
            self._sizes = np.append(self._sizes, np.zeros_like(self._sizes))
        self.n += 1
        self.add(self.n - 1, u, 1)
        return self.n - 1, True

    def add(self, at: int, total: np.ndarray, n: int) -> None:
        self._sums[at] += total
        self._sizes[at] += n
        self._means[at] = self._sums[at] / self._sizes[at]


class Rounds:
    """The batches over a table of (n, u): number in the order from 1, unit vector."""

    def __init__(self, rows: DataFrame, n: int, dims: int, threshold: float, first: int, undecided: int):
        self.rows, self.n, self.threshold, self.undecided = rows, n, threshold, undecided
        self.concepts = Concepts(dims)
        self.done, self.batch, self.first = 0, first, first
        self.folder = new_path(rows.sparkSession, "leaders")
        #: Rows decided one by one, and the number of batches.
        self.alone, self.batches = 0, 0
        self.most = max(first, undecided, min(MOST, HELD // (8 * max(dims, 1))))
        #: Where the order decides most rows, the number of rows up to which they are decided without a batch.
        self.ordered = 0

    def slice(self, high: int) -> DataFrame:
        return self.rows.where((F.col("n") > self.done) & (F.col("n") <= high))

    def save(self, decided: DataFrame) -> None:
        decided.select(F.col("n").cast("long"), F.col("c").cast("int")).write.mode("append").parquet(self.folder)

    def one_by_one(self, high: int) -> None:
        """A few rows, all on the driver."""
        rows = self.slice(high).orderBy("n").toArrow()
        u = rows["u"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        c = [self.concepts.take(x, self.threshold)[0] for x in u]
        self.save(self.rows.sparkSession.createDataFrame(pa.table({"n": rows["n"].cast(pa.int64()), "c": pa.array(c, pa.int32())})))
        self.alone += len(c)
        self.done = high

    def run(self) -> DataFrame:
        """(n, c) of every row."""
        self.one_by_one(min(self.first, self.n))
        while self.done < self.n:
            before = self.done
            if before < self.ordered:
                self.one_by_one(min(2 * before, before + self.most, self.ordered, self.n))
                continue
            if self.n - before > self.first:
                alone = self.alone
                self.together(min(before + self.batch, self.n))
                if 4 * (self.alone - alone) > 3 * (self.done - before):
                    self.ordered = 2 * self.done
            if self.done - before < self.first // 4:
                self.one_by_one(min(self.done + self.first, self.n))
        return self.rows.sparkSession.read.parquet(self.folder)

    def together(self, high: int) -> None:
        """Decide the rows up to `high`, or fewer of them."""
        t, means, sizes = self.threshold, self.concepts.means(), self.concepts.sizes
        piece = self.slice(high)

        def near(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(means), np.int64)
            for p in parts:
                for at in range(0, len(p), 4096):
                    total += (to_means(np.stack(p.u[at : at + 4096]), means) <= 1.5 * t).sum(0)
            yield pd.DataFrame({"c": np.arange(len(means)), "k": total})

        # at most so many rows can join a concept, as long as its mean moves by half a threshold or less
        joins = np.zeros(len(means))
        for r in piece.mapInPandas(near, "c int, k long").groupBy("c").agg(F.sum("k").alias("k")).collect():
            joins[r.c] = r.k
        moves = t * np.log1p(joins / sizes) * (1 + 1e-9) + 1e-12
        # means of few rows may move further: only rows decided one by one join them, and how far they go is watched
        loose = moves > 0.25 * t
        moves[loose] = 0.5 * t

        def judged(u: np.ndarray, founders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(the nearest mean, whether it is certain, whether the row may found a concept)."""
            d = to_means(u, means)
            best = d.argmin(1)
            most = d[np.arange(len(u)), best] + moves[best]
            low = d - moves
            low[np.arange(len(u)), best] = np.inf
            sure = ~loose[best] & (most <= t - 1e-9) & (most + 1e-9 < low.min(1))
            if len(founders):
                sure &= to_means(u, founders).min(1) > most + 0.5 * t
            return best, sure, most > t - 1e-9

        def open_rows(founders: np.ndarray) -> DataFrame:
            def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for p in parts:
                    for at in range(0, len(p), 4096):
                        q = p.iloc[at : at + 4096]
                        _, sure, may = judged(np.stack(q.u), founders)
                        yield q.assign(may=may)[~sure]

            return piece.mapInPandas(run, "n long, u array<double>, may boolean")

        none = np.zeros((0, means.shape[1]))
        rows = open_rows(none).orderBy("n").limit(self.undecided + 1).collect()
        if len(rows) > self.undecided:
            high = int(rows[-1].n) - 1
            rows.pop()
        founders = np.array([r.u for r in rows if r.may]).reshape(-1, means.shape[1])
        if len(founders):
            rows = open_rows(founders).where(F.col("n") <= high).orderBy("n").limit(self.undecided + 1).collect()
            if len(rows) > self.undecided:
                high = int(rows[-1].n) - 1
                rows.pop()
        numbers = np.array([r.n for r in rows], np.int64)
        last = high

        def between(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                p = p[p.n <= last]
                for at in range(0, len(p), 4096):
                    q = p.iloc[at : at + 4096]
                    u, n = np.stack(q.u), q.n.to_numpy()
                    best, _, _ = judged(u, founders)
                    sure = ~np.isin(n, numbers)
                    yield pd.DataFrame({"n": n[sure], "c": best[sure].astype(np.int32), "u": list(u[sure]), "s": np.searchsorted(numbers, n[sure])})

        def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in between(parts):
                if len(p):
                    v = np.stack(p.u)
                    for (s, c), at in p.groupby(["s", "c"]).indices.items():
                        yield pd.DataFrame({"s": [s], "c": [c], "k": [len(at)], "total": [v[at].sum(0)]})

        parts: dict[int, list] = {}
        # rows lie in order, so a task has few stretches; there are at most as many sums as rows in the batch
        for r in piece.mapInPandas(summed, "s long, c int, k long, total array<double>").orderBy("s", "c").collect():
            parts.setdefault(r.s, []).append(r)
        watched, decided = {int(c): means[c] for c in np.flatnonzero(loose)}, []
        for s in range(len(rows) + 1):
            for r in parts.get(s, ()):
                self.concepts.add(r.c, np.asarray(r.total), r.k)
            if s == len(rows):
                break
            u = np.asarray(rows[s].u)
            c, new = self.concepts.take(u, t)
            decided.append((int(rows[s].n), c))
            if new:
                watched[c] = u
            elif c in watched and np.linalg.norm(self.concepts.sums[c] / self.concepts.sizes[c] - watched[c]) > 0.5 * t - 1e-9:
                high = int(rows[s].n)  # beyond what was allowed for: what follows is measured again
                break
        end = high

        def certain(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in between(parts):
                yield p.loc[p.n <= end, ["n", "c"]]

        spark = self.rows.sparkSession
        self.save(piece.mapInPandas(certain, "n long, c int").union(spark.createDataFrame(decided, "n long, c int")))
        self.alone += len(decided)
        self.batches += 1
        took, self.done = end - self.done, end
        wanted = took * self.undecided // (2 * max(len(decided), 1)) if decided else 2 * took
        self.batch = max(self.first, min(wanted, self.done // 4, 32 * self.undecided))


def leader_clusters(selected: DataFrame, threshold: float = 0.35, first: int = 2048, undecided: int = 4096) -> DataFrame:
    """selected (position, id, score, v, ...) with concept_id: each vector joins the nearest running mean of unit vectors
    within threshold, the first of equal ones, or founds a concept, in the order of position, which is unique.

    Vectors have one length. `first` rows, and of each batch `undecided` ones at most, are on the driver at a time; it also
    holds a sum for each concept.
    """
    got, _ = clustered(selected, threshold, first, undecided)
    return got


def clustered(selected: DataFrame, threshold: float, first: int, undecided: int) -> tuple[DataFrame, Rounds | None]:
    n = selected.count()
    named = F.format_string("concept-%04d", F.col("_c") + 1).alias("concept_id")
    if not n:
        return selected.withColumn("concept_id", F.lit(None).cast("string")), None
    dims = selected.select(F.size("v").alias("d")).first().d

    def units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                yield p.assign(v=list(unit(np.stack(p.v).astype(float))))

    placed = numbered(selected.select("position", "v"), "position", "n").select(F.col("n").cast("long").alias("n"), F.col("v").cast("array<double>").alias("v"))
    stale: list[str] = []
    ordered = placed.mapInPandas(units, "n long, v array<double>").withColumnRenamed("v", "u").repartitionByRange("n").sortWithinPartitions("n")
    rounds = Rounds(cut(ordered, "units", stale), n, dims, threshold, first, undecided)
    decided = rounds.run()
    drop(selected.sparkSession, stale)
    numbers = numbered(selected, "position", "_n")
    out = numbers.join(decided.select(F.col("n").alias("_n"), F.col("c").alias("_c")), "_n")
    return out.select(*selected.columns, named), rounds
