"""Exact removal of repeated substrings by level-wise doubling.

Windows grow from a quarter of the full length to a half and to the whole. At a level each window that is still in play
chooses the run of that many words whose hash is smallest among those it holds, so equal windows choose equal runs and a
level costs few rows. Runs are counted; a run that occurs once rules out every window that chose it, and only the others
are extended to twice the length. At full length a window is repeated if its words also start earlier: in a smaller
doc_id, or earlier in the same document. Longer windows cover no further words, so removal ends there; `longest_repeats`
goes on doubling, among the documents that still hold a repeated window, until none survives.

Which runs are repeated is told to the tasks by a bit filter, sized by their number; its false alarms only make more
windows go on. At full length two hashes of the words, 96 bits in all, decide. Each task sends one row for each
different window, its first place, to Spark; the later places in that task are repeats already.

Edge cases: null texts have no words; documents with fewer words than a window lose nothing; rows that share
a doc_id are one document: a window at the same start in them is one place, and what is removed from one row is removed
at the same place of the others; a null doc_id sorts before all others; extra columns are ignored by remove_repeats()
and kept by clean(), whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, Powers, cut, hash_ranges, mix, pack, slices, spread, squeeze, unpack, word_hashes

WINDOW = 20


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space, unchanged."""
    return (text or "").encode(errors="surrogatepass").split()


def chosen(half: np.ndarray, run: int) -> np.ndarray:
    """For each window, the index of the smallest of its `run` half windows (the leftmost of equal ones)."""
    n = len(half) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(half, run)
    return np.arange(n) + view.argmin(1)


#: Multipliers of the two hashes of a run of words.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def runs(w: np.ndarray, k: int, base: int = FIRST) -> np.ndarray:
    """A polynomial in the words' hashes for each run of k words, by doubling."""
    if len(w) < k:
        return w[:0]
    if k == 1:
        return w
    half = k // 2
    h = runs(w, half, base)
    h = h[:-half] * np.uint64(pow(base, half, 1 << 64)) + h[half:]
    return h[:-1] * np.uint64(base) + w[k - 1 :] if k % 2 else h


def lengths(window: int) -> list[int]:
    """The lengths of the levels below the full one."""
    return sorted({window // 4, window // 2} - {0, window})


def survivors(w: np.ndarray, window: int, repeated: list[BitFilter]) -> np.ndarray:
    """The starts of the windows whose chosen runs at all known levels are repeated."""
    alive = np.arange(max(len(w) - window + 1, 0))
    for k, known in zip(lengths(window), repeated):
        if not len(alive):
            break
        h = mix(runs(w, k))
        alive = alive[known.has(h)[chosen(h, window - k + 1)[alive]]]
    return alive


def seed_counts(docs: DataFrame, window: int, repeated: list[BitFilter]) -> DataFrame:
    """(h, n): how often each run that a surviving window chooses at the next level occurs, counted in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)
    k = lengths(window)[len(repeated)]
    out = pa.schema([("h", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, size = Powers(), [], 0
        for b in slices(batches):
            for w in word_hashes(b.column(0), powers):
                alive = survivors(w, window, shared.value)
                if len(alive):
                    h = mix(runs(w, k))
                    held.append(h[np.unique(chosen(h, window - k + 1)[alive])])
                    size += len(held[-1])
            if size > 2_000_000:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], schema=out)

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


ROWS = pa.schema([("range", pa.int32()), ("flush", pa.int64()), ("blob", pa.binary())])
PLACE = [("doc", "<i8"), ("at", "<i4"), ("check", "<u4")]
FLUSH = 600_000


def starts_of(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where another window's words begin in places sorted by both hashes."""
    return np.concatenate([[True], (h[1:] != h[:-1]) | (place["check"][1:] != place["check"][:-1])])


def in_order(h: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.lexsort((place["at"], place["doc"], place["check"], h))
    return h[o], place[o], starts_of(h[o], place[o])


def places(docs: DataFrame, window: int, repeated: list[BitFilter], ranges: int) -> DataFrame:
    """(range, flush, blob): a task's first place of every window that goes on, sorted by the window's hash and cut into
    ranges of hashes; and, with a negative range, the later places in that task."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, task, number = Powers(), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in slices(batches):
            for d, w in zip(b.column(0).to_pylist(), word_hashes(b.column(1), powers)):
                go = survivors(w, window, shared.value)
                if len(go):
                    check = mix(runs(w, window, SECOND)[go]) >> np.uint64(32)
                    held.append((mix(runs(w, window)[go]), check.astype(np.uint32), np.full(len(go), d, np.int64), go.astype(np.int32)))
                    size += len(go)
                if size > FLUSH:
                    yield from sent(held, task << 24 | number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from sent(held, task << 24 | number)

    def sent(held: list, flush: int) -> Iterator[pa.RecordBatch]:
        h, check, d, at = (np.concatenate(c) for c in zip(*held))
        place = np.empty(len(h), PLACE)
        place["doc"], place["at"], place["check"] = d, at, check
        h, place, new = in_order(h, place)
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        # a later row of the very same place (a repeated row of the table) is no later place
        late = ~new & (place != place[first])
        rows = [(-1 - flush % ranges, flush, squeeze(np.sort(place[late], order=("doc", "at"))))] if late.any() else []
        h, place = h[new], place[new]
        step = -(-(1 << 64) // ranges)
        edge = np.append(np.searchsorted(h, np.array([r * step for r in range(ranges)], np.uint64)), len(h))
        for r in np.flatnonzero(np.diff(edge)):
            part = slice(edge[r], edge[r + 1])
            head = pack(h[part])
            rows.append((int(r), flush, len(head).to_bytes(8, "little") + head + squeeze(place[part])))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 256]), ROWS)], schema=ROWS)

    return docs.mapInArrow(run, "range int, flush long, blob binary")


def later_places(found: DataFrame) -> DataFrame:
    """(flush, blob): each flush's places of windows whose words start earlier anywhere."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if p.range.iloc[0] < 0:
            return p[["flush", "blob"]]
        hs, ps = [], []
        for b in p.blob:
            n = int.from_bytes(b[:8], "little")
            hs.append(unpack(b[8 : 8 + n]))
            ps.append(spread(b[8 + n :], PLACE))
        flush = np.repeat(np.arange(len(hs)), [len(h) for h in hs])
        h, place = np.concatenate(hs), np.concatenate(ps)
        o = np.lexsort((place["at"], place["doc"], place["check"], h))
        h, place, flush = h[o], place[o], flush[o]
        new = starts_of(h, place)
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        late = np.flatnonzero(~new & (place != place[first]))
        late = late[np.argsort(flush[late], kind="stable")]
        edge = np.searchsorted(flush[late], np.arange(len(hs) + 1))
        out = [(p.flush.iloc[i], squeeze(np.sort(place[late[edge[i] : edge[i + 1]]], order=("doc", "at")))) for i in range(len(hs)) if edge[i + 1] > edge[i]]
        return pd.DataFrame(out, columns=["flush", "blob"])

    return found.groupBy("range").applyInPandas(run, "flush long, blob binary")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, starts): the starts of the windows of each document whose words also start earlier.

    docs holds doc_id (no nulls) and text.
    """
    repeated: list[BitFilter] = []
    for _ in lengths(window):
        repeated.append(BitFilter.of(seed_counts(docs, window, repeated).where("n > 1").select("h")))

    def by_document(p: pd.DataFrame) -> pd.DataFrame:
        place = np.sort(np.concatenate([spread(b, PLACE) for b in p.blob]), order=("doc", "at"))
        doc, edge = np.unique(place["doc"], return_index=True)
        return pd.DataFrame({"doc_id": doc, "starts": np.split(place["at"], edge[1:])})

    late = later_places(places(docs, window, repeated, hash_ranges(docs))).groupBy("flush").applyInPandas(by_document, "doc_id long, starts array<int>")
    # rows that share an id may lie in several tasks
    return late.groupBy("doc_id").agg(F.flatten(F.collect_list("starts")).alias("starts"))


NO_ID = -(1 << 63)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words joined by a space) for every row of docs."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = repeats(rows, window)
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = []
            for d, t, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, w = kept_words(t, starts, window)
                kept = b" ".join(w)
                got.append((None if d == NO_ID else d, n, n - len(w), hashlib.sha256(kept).hexdigest(), kept.decode(errors="surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got) if got else [()] * 5, out)], schema=out)

    joined = rows.join(cuts, "doc_id", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def kept_words(text: str | None, starts: pa.ListScalar, window: int) -> tuple[int, list[bytes]]:
    """(number of words, the words that no repeated window covers)."""
    w = words(text)
    n = len(w)
    if starts.is_valid and n:
        s = np.asarray(starts.values)
        s = s[s <= n - window]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + window, -1)
        w = [x for x, k in zip(w, (np.cumsum(edge[:n]) == 0).tolist()) if k]
    return n, w


def clean(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text and any other columns) with the kept words as text; texts that lose nothing stay unchanged.

    Documents that lose every word are left out. A column n_chars is set to the new length.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"))
    cuts = repeats(rows.select(F.col("key").alias("doc_id"), F.col("row.text").cast("string").alias("text")), window)
    joined = rows.join(cuts.withColumnRenamed("doc_id", "key"), "key", "left").select("row", "starts")
    column = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, keep = [], []
            columns = b.column(0).flatten()
            for t, starts in zip(columns[column].to_pylist(), b.column(1)):
                if starts.is_valid:
                    n, w = kept_words(t, starts, window)
                    keep.append(bool(w) or not n)
                    t = t if len(w) == n else b" ".join(w).decode(errors="surrogatepass")
                else:
                    keep.append(True)
                texts.append(t)
            columns[column] = pa.array(texts, columns[column].type)
            if chars is not None:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, docs.schema)


def longest_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(length, n): windows of each length that start earlier too, for lengths doubled until none survives.

    Only documents that hold a repeated window of one length, at its first place or a later one, are read for the next.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, length = [], window
    while True:
        starts = cut(repeats(rows, length), "repeats")
        n = starts.agg(F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()[0]
        if not n:
            break
        found.append((length, n))
        # a first place may lie in a document without later ones, so those that choose a repeated run stay as well
        known = docs.sparkSession.sparkContext.broadcast(BitFilter.of(seed_counts(rows, 2 * length, []).where("n > 1").select("h")))

        def alive(batches: Iterator[pa.RecordBatch], length: int = length, known=known) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            for b in batches:
                yield b.filter(pa.array([len(survivors(w, 2 * length, [known.value])) > 0 for w in word_hashes(b.column(1), powers)], pa.bool_()))

        rows = cut(rows.mapInArrow(alive, rows.schema), "survivors")
        length *= 2
    return docs.sparkSession.createDataFrame(found, "length int, n long")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
g AS (SELECT doc_id, i, md5(string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)) AS h,
             count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n FROM w),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g WHERE n = 20),
c AS (SELECT w.doc_id, w.i, w.w, max(coalesce(CASE WHEN r.k > 1 THEN 1 END, 0)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
s AS (SELECT doc_id, count(*) AS n_words, sum(gone)::bigint AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s USING (doc_id)
"""
