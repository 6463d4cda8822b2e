"""Vector codes by product codebooks, fitted with Yinyang Lloyd.

Vectors of whole numbers are cut into equal parts; each part position has a codebook, and a vector's code is the nearest
entry of each. The entries of a codebook are dealt to a few groups by where they start. A vector keeps one lower bound
a group on its distance to the entries of the group other than its own; when entries move, the bound sinks by the
largest move in the group. Only groups whose bound does not exceed the distance to the vector's own entry are measured
again. Bounds are rounded down and compared with a margin, and the entries within the margin of the nearest are compared
as whole numbers, ties to the lower index, so that codes equal those of the plain loop.

State (whole numbers, code, bounds) lies in a table of the shared folder from pass to pass. A pass writes the next state
and, in rows of the same table, each task's sums and counts of an entry, so that a codebook is moved by an aggregation
over a few rows a task.

Edge cases: vectors that are null, empty, of a length that is no multiple of the number of parts, of another length than
the vector of the smallest id that is left, or that hold null or non-finite components take no part. Equal rows are coded one
by one; the first codebook takes rows by (vec_id, vector), null ids last. With fewer rows than entries there are as many
entries as rows; with none the result is empty. Extra columns are ignored. Whole numbers beyond 2^25 in size (components
beyond 2^17) raise ValueError: sums of their squares would not be exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop

#: Largest whole number: differences and their squares then stay exact in doubles and in 64 bits.
MOST = 1 << 25
STATE = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.binary()), ("code", pa.binary()), ("low", pa.binary()), ("error", pa.int64()), ("measured", pa.int64()), ("sums", pa.binary())])
STATE_DDL = "vec_id long, label string, v binary, code binary, low binary, error long, measured long, sums binary"


def usable(rows: DataFrame, parts: int) -> DataFrame:
    """vec_id, label and v, the whole numbers floor(256 x), of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("v"))
    return rows.where((F.size("v") > 0) & (F.size("v") % parts == 0) & ok)


def whole(v: np.ndarray) -> np.ndarray:
    x = np.floor(256 * v)
    if len(x) and np.abs(x).max() > MOST:
        raise ValueError(f"components beyond {MOST / 256:g} are not coded exactly")
    return x.astype(np.int64)


def groups_of(entries: np.ndarray, n: int, rounds: int = 5) -> np.ndarray:
    """The group of each entry of one codebook: a few rounds of Lloyd over the entries themselves."""
    x = entries.astype(float)
    centres = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)]
    for _ in range(rounds):
        at = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([x[at == g].mean(0) if (at == g).any() else c for g, c in enumerate(centres)])
    return at


class Codebooks:
    """entries[part, entry, position]; group[part, entry]; after a move also how far each group has moved at most."""

    def __init__(self, entries: np.ndarray, group: np.ndarray, moved: np.ndarray | None = None):
        self.entries, self.group, self.moved = entries, group, moved

    @classmethod
    def first(cls, vectors: np.ndarray, parts: int, groups: int) -> "Codebooks":
        e = vectors.reshape(len(vectors), parts, -1).transpose(1, 0, 2).copy()
        return cls(e, np.stack([groups_of(p, groups) for p in e]))

    def after(self, sums: np.ndarray, counts: np.ndarray) -> "Codebooks":
        """The entries at the whole means of their parts; unused ones stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        drift = np.sqrt(((new - self.entries) ** 2).sum(2).astype(float)) * (1 + 1e-12)
        moved = np.stack([[d[g == k].max(initial=0) for k in range(g.max() + 1)] + [0.0] * (self.group.max() - g.max()) for d, g in zip(drift, self.group)])
        return Codebooks(new, self.group, moved)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries; MOST keeps every sum exact."""
    return ((x[:, None, :] - e[None]) ** 2).sum(2)


def down(r: np.ndarray) -> np.ndarray:
    """Bounds rounded down to 16 bits; the largest number that fits stands for larger ones."""
    r = np.minimum(r, 65504.0)
    h = r.astype(np.float16)
    return np.where(h.astype(float) > r, np.nextafter(h, np.float16(0)), h)


def root(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(float)) * (1 - 1e-12)


def assign_part(x: np.ndarray, e: np.ndarray, group: np.ndarray, n_groups: int, moved: np.ndarray | None, code: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One part position of some vectors: (code, bounds, squared error, entries measured for each row).

    Without code and bounds all groups are measured.
    """
    n = len(x)
    far = np.iinfo(np.int64).max
    if code is None:
        own = np.zeros(n, np.int64)
        own_d = np.full(n, far)
        low = np.zeros((n, n_groups))
        scan = np.ones((n, n_groups), bool)
    else:
        own = code.astype(np.int64)
        own_d = ((x - e[own]) ** 2).sum(1)
        low = np.maximum(low.astype(float) - moved, 0)
        scan = low <= np.sqrt(own_d)[:, None] * (1 + 1e-9) + 1e-9
    was, was_d = own.copy(), own_d.copy()
    measured = np.full(n, 0 if code is None else 1)
    best, best_d, kept = own, own_d, []
    for g in range(n_groups):
        members = np.flatnonzero(group == g)
        rows = np.flatnonzero(scan[:, g])
        if not len(members):
            low[:, g] = 65504.0
            continue
        if not len(rows):
            continue
        d = squared(x[rows], e[members])
        measured[rows] += len(members)
        at = d.argmin(1)  # the first of equal ones: members are in order
        got, least = members[at], d[np.arange(len(rows)), at]
        nearer = (least < best_d[rows]) | ((least == best_d[rows]) & (got < best[rows]))
        best[rows[nearer]], best_d[rows[nearer]] = got[nearer], least[nearer]
        kept.append((g, members, rows, d))
    for g, members, rows, d in kept:  # the bound is on the others of the group: take the row's own entry out
        mine = members[None] == best[rows][:, None]
        low[rows, g] = root(np.where(mine, far, d).min(1))
    if code is not None:  # the entry that was left counts among the others of its group, measured or not
        left = np.flatnonzero(best != was)
        at = group[was[left]]
        low[left, at] = np.minimum(low[left, at], root(was_d[left]))
    return best, down(low), best_d, measured


def passes(state: DataFrame, books: Codebooks, parts: int, last: bool) -> DataFrame:
    """The state after assigning every vector to the codebooks, and the tasks' sums (rows with `sums` alone).

    After the last pass there are codes and errors, but neither vectors, bounds nor sums.
    """
    shared = state.sparkSession.sparkContext.broadcast((books.entries, books.group, books.moved))
    n_groups = int(books.group.max()) + 1 if books.group.size else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, group, moved = shared.value
        width = entries.shape[2]
        sums, counts = np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                p = b.slice(i, 2048)
                n = p.num_rows
                if not n:
                    continue
                x = np.frombuffer(b"".join(p.column("v").to_pylist()), "<i4").reshape(n, parts, width).astype(np.int64)
                known = p.column("code").null_count == 0
                if known:
                    old = np.frombuffer(b"".join(p.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    low = np.frombuffer(b"".join(p.column("low").to_pylist()), "<f2").reshape(n, parts, n_groups)
                code, bounds = np.empty((n, parts), np.uint8), np.empty((n, parts, n_groups), "<f2")
                error, measured = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for k in range(parts):
                    got = assign_part(x[:, k], entries[k], group[k], n_groups, moved[k] if known else None, old[:, k] if known else None, low[:, k] if known else None)
                    code[:, k], bounds[:, k] = got[0], got[1]
                    error += got[2]
                    measured += got[3]
                    if not last:
                        np.add.at(sums[k], got[0], x[:, k])
                        counts[k] += np.bincount(got[0], minlength=counts.shape[1])
                nothing = pa.nulls(n, pa.binary())
                v, kept = (nothing, nothing) if last else (p.column("v"), pa.array([r.tobytes() for r in bounds], pa.binary()))
                yield pa.RecordBatch.from_arrays([p.column("vec_id"), p.column("label"), v, pa.array([r.tobytes() for r in code], pa.binary()), kept, pa.array(error), pa.array(measured), nothing], schema=STATE)
        if not last and counts.any():
            blob = np.concatenate([sums.ravel(), counts.ravel()]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob] if f.name == "sums" else [None], f.type) for f in STATE], schema=STATE)

    return state.mapInArrow(run, STATE_DDL)


def totals(state: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of every entry over all tasks; the driver gets a row for each number, at most a few thousand."""
    size = books.entries.size
    n = size + books.entries.size // books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for blob in b.column(0).to_pylist():
                total += np.frombuffer(blob, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "x"])

    got = state.select("sums").where("sums is not null").mapInArrow(run, "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(n, np.int64)
    flat[got.column("at").to_numpy()] = got.column("x").to_numpy()
    return flat[:size].reshape(books.entries.shape), flat[size:].reshape(books.entries.shape[:2])


def fit(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 6) -> tuple[DataFrame, Codebooks | None]:
    """The last state (vec_id, label, code, error, measured: entries looked at in the last pass) of the rows
    (vec_id, embedding, label) that take part, and the codebooks; None where no row does."""
    if not 0 < entries <= 256:
        raise ValueError("a code of one byte has 1 to 256 entries")
    spark: SparkSession = rows.sparkSession
    kept = usable(rows, parts)
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    if not start:
        return spark.createDataFrame([], STATE_DDL), None
    kept = kept.where(F.size("v") == len(start[0].v))
    seeds = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    books = Codebooks.first(whole(np.array([r.v for r in seeds])), parts, groups)

    def to_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = whole(b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)).astype("<i4")
                none = pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in x], pa.binary()), none, none, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64()), none], schema=STATE)

    state, stale = kept.mapInArrow(to_whole, STATE_DDL), []
    for _ in range(rounds):
        written: list[str] = []
        state = cut(passes(state, books, parts, False), "codes", written)
        drop(spark, stale)
        stale = written
        books = books.after(*totals(state, books))
        state = state.where("sums is null")
    state = cut(passes(state, books, parts, True), "codes")
    drop(spark, stale)
    return state, books


def encode(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 6, most_labels: int = 100_000) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error, codebooks_sha256 of every row that takes part.

    label_error is the error summed over equal labels, nulls together; the sums are broadcast if they are at most
    `most_labels`, and joined by label otherwise.
    """
    state, books = fit(rows, parts, entries, rounds, groups)
    sums = state.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if books is None or sums.limit(most_labels + 1).count() <= most_labels:
        sums = F.broadcast(sums)
    sha = books.sha256() if books else None
    return state.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).cast("string").alias("codebooks_sha256"))


def op13_yinyang_codes(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assign_sql(books: str, name: str) -> str:
    return f"""{name} AS (SELECT row, part, arg_min(e, dist * 64 + e) AS e, min(dist) AS dist, any_value(x) AS x FROM
 (SELECT p.row, p.part, b.e, p.x, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.c[i]) * (p.x[i] - b.c[i])))::bigint AS dist FROM p JOIN {books} b USING (part)) GROUP BY row, part)"""


def _move_sql(assigned: str, books: str, name: str) -> str:
    return f"""{name} AS (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (SELECT part, e, list(s ORDER BY i) AS c FROM
 (SELECT part, e, i, floor(sum(x[i])::double / count(*))::bigint AS s FROM (SELECT part, e, x, unnest(range(1, len(x) + 1)) AS i FROM {assigned}) GROUP BY part, e, i) GROUP BY part, e) m USING (part, e))"""


#: The plain loop: every part against every entry, three times.
OP13_SQL = f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT row, g.part, v[g.part * (len(v) // 16) + 1 : (g.part + 1) * (len(v) // 16)] AS x FROM k, range(0, 16) g(part)),
b0 AS (SELECT part, row - 1 AS e, x AS c FROM p WHERE row <= 64),
{_assign_sql("b0", "a0")}, {_move_sql("a0", "b0", "b1")}, {_assign_sql("b1", "a1")}, {_move_sql("a1", "b1", "b2")}, {_assign_sql("b2", "a2")},
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b2),
r AS (SELECT row, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(dist)::bigint AS error FROM a2 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM k JOIN r USING (row), h"""
