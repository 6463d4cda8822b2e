"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_M = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own, for there all tasks run on one machine; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        path = _own[context.applicationId] = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, path, True)
    return _own[context.applicationId]


_own: dict[str, str] = {}


def cut(df: DataFrame, name: str, into: list[str] | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there and lost executors cost nothing.

    into: gets the path, for drop(). by: a column whose values get a folder each.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    if into is not None:
        into.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Statements inside leave no shuffle files behind once they have written: else those stay until the driver happens to
    collect its garbage. For steps that end in cut(); the session's setting is put back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of cut() that nothing will read again, through Spark's file systems."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    paths.clear()


def hash_ranges(docs: DataFrame, each: int = 32 << 20) -> int:
    """How many ranges of hashes the docs' words are dealt to: one for each 32 MB of text, and some for each shuffle task."""
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    return max(-(-size // each), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def crc_mod(col, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


class Hashes(dict):
    """word (bytes) -> 63-bit hash, remembered up to a bound that only saves work."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are words' and not white space's, and the base of their polynomial, which is odd and so has an inverse.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
BASE, LONG = 0xD6E8FEB86659FD93, 64
#: Bytes with A to Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Powers:
    """Powers of BASE and of its inverse, as many as the longest stretch of texts needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.full(n, b, np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64)))
            for x in (self.up, self.down):
                x[0] = 1
                np.cumprod(x, out=x)


def word_hashes(texts: pa.Array, powers: Powers, most: int = 1 << 20, lower: bool = False) -> Iterator[np.ndarray]:
    """For each text the hashes of its runs of characters other than ASCII white space, read from the bytes of some texts at a time, without an object for each word.

    A polynomial in a word's bytes, mixed; words of more than LONG bytes, where such polynomials have collisions that can
    be written down, go through xxHash.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offset = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole, low = texts.buffers()[2], 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offset, offset[low] + most, "right")) - 1)
        edge = offset[low : high + 1] - offset[low]
        n = int(edge[-1])
        low, first = high, int(offset[low])
        if not n:
            yield from (np.zeros(0, np.uint64) for _ in edge[1:])
            continue
        raw = np.frombuffer(whole, np.uint8, n, first)
        if lower:
            raw = LOWER[raw]
        powers.reach(n)
        word = WORD[raw]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        border = edge[edge < n]
        before[border] = False
        after[edge[edge > 0] - 1] = False
        start, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=total[1:])
        h = mix((total[end] - total[start]) * powers.down[start])
        for i in np.flatnonzero(end - start > LONG):
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes())
        yield from np.split(h, np.searchsorted(start, edge[1:-1]))


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k word hashes."""
    if len(w) < k:
        return w[:0]
    h = w[: len(w) - k + 1].copy()
    for j in range(1, k):
        h = h * _M + w[j : len(w) - k + 1 + j]
    return mix(h)


_Z = None


def pack(a: np.ndarray) -> bytes:
    """Sorted unsigned integers as zstd-packed byte planes of their differences."""
    global _Z
    _Z = _Z or (zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor())
    d = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return len(a).to_bytes(8, "little") + _Z[0].compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    global _Z
    _Z = _Z or (zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor())
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(_Z[1].decompress(b[8:]), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def squeeze(table: np.ndarray) -> bytes:
    """A structured array, compressed by byte planes."""
    global _Z
    _Z = _Z or (zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor())
    width = table.dtype.itemsize
    return _Z[0].compress(np.ascontiguousarray(table.view(np.uint8).reshape(-1, width).T).tobytes())


def spread(blob: bytes, dtype: list | str) -> np.ndarray:
    global _Z
    _Z = _Z or (zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor())
    dtype = np.dtype(dtype)
    raw = np.frombuffer(_Z[1].decompress(blob), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def sized(*parts: bytes) -> bytes:
    """The parts, each after its length."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parts_of(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for every node of the edges that is not the smallest of its component among them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        old = label
        low = np.minimum(label[x], label[y])
        label = label.copy()
        np.minimum.at(label, old[x], low)
        np.minimum.at(label, old[y], low)
        label = label[label]
        if (label == old).all():
            break
    rest = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[rest], nodes[label[rest]]


def forests(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(a, b): what connects the edges of each task as stars around their smallest nodes; `most` edges at a time."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for e in batches:
            held.append((e.column(0).to_numpy(), e.column(1).to_numpy()))
            size += e.num_rows
            if size >= most:
                held = [forest(*(np.concatenate(c) for c in zip(*held)))]
                if len(held[0][0]) > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], schema=out)
                    held = []
                size = sum(len(c) for c, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*(np.concatenate(c) for c in zip(*held)))], schema=out)

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, thin: bool = True, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Tasks first thin out their edges to stars, unless `thin` is false: edges that Python made would need a second Python
    worker for it in the same task, and Spark keeps its memory. Then each round takes the smallest label among the neighbours and jumps
    along labels, so long chains end in a logarithmic number of rounds. Only keyed joins and min() are used: no group is
    gathered. Tables of labels are much smaller than the texts that the number of shuffle partitions is meant for, so
    they are written in a quarter as many parts.
    """
    spark = edges.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    kept, stale = [], []
    # tasks that hold parts of the same group find the same stars
    stars = cut((forests(edges) if thin else edges.select("a", "b").where("a <> b")).distinct(), "stars", kept)
    both = stars.union(stars.select("b", "a"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")).coalesce(parts), "labels", stale)
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("old"))
        new = labels.select("node", "component", F.col("component").alias("old")).union(near).groupBy("node").agg(F.min("component").alias("l"), F.min("old").alias("old"))
        up = labels.select(F.col("node").alias("at"), F.col("component").alias("root"))
        jumped = new.join(up, F.col("l") == F.col("at")).select("node", F.least("l", "root").alias("component"), "old")
        seen = Observation()
        written: list[str] = []
        labels = cut(jumped.coalesce(parts).observe(seen, F.sum((F.col("component") != F.col("old")).cast("long")).alias("changed")).select("node", "component"), "labels", written)
        drop(spark, stale)
        stale = written
        if not seen.get["changed"]:
            break
    else:
        raise RuntimeError("components did not settle")
    drop(spark, kept)
    return labels


class BitFilter:
    """A bit for each key's hash: says no only where the key was never put in."""

    #: 32 MB. With more keys than fit, the filter says yes more often and results stay the same.
    MOST = 28

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.log2 = bits, log2

    @classmethod
    def of(cls, keys: DataFrame, log2: int | None = None) -> "BitFilter":
        """From a DataFrame with one bigint column: 8 bits for each key, 2^MOST at most; or 2^log2.

        The driver gets a row of two words for every 64 bits at most.
        """
        (c,) = keys.columns
        stale: list[str] = []
        if log2 is None:
            counted = Observation()
            keys = cut(keys.observe(counted, F.count(F.lit(1)).alias("n")), "keys", stale)
            log2 = min(max((8 * counted.get["n"]).bit_length(), 10), cls.MOST)
        at = F.shiftrightunsigned(F.col(c), 64 - log2)
        words = keys.select(at.alias("at")).select(F.shiftright("at", 6).alias("w"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("b"))
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        drop(keys.sparkSession, stale)
        bits = np.zeros(1 << (log2 - 6), np.int64)
        bits[got.column("w").to_numpy()] = got.column("b").to_numpy()
        return cls(bits.view(np.uint64), log2)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> np.uint64(64 - self.log2)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
