"""Media columns: documents' bytes as 8-bit mono WAV, chunked by content, stored once and read back.

A text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64, are the samples of a WAV. A rolling gear hash
cuts the WAV's bytes where their content says so. A first scan lists the digests of every document's chunks; Spark counts
them. A second scan writes an object row for each document with the ordered digests and the chunks that only it holds,
and a row for each shared chunk; Spark keeps one row of each chunk and of each object that shares some. Reading joins the
shared chunks by digest to the objects that list them and puts each WAV together again; its SHA-256 must be the one that
the object is known by. Payload and features come from parsing that WAV.

Which digests are shared is told by a bit filter, sized by their number; a false alarm only stores a chunk apart. Objects
that share nothing are read back where they lie, without a shuffle.

Edge cases: null and empty texts are 64 bytes 0; copies share their object, so equal texts have equal values; rows with
a repeated or null doc_id each get their row; very long texts are cut into chunks of at most `most` bytes each; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BitFilter, cut, drop, tidy, mix

UNIT = 64
#: 256 random words, from a rule
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode(errors="surrogatepass")
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Unsigned 8-bit mono PCM with a 44-byte header."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def wav_samples(stored: bytes) -> bytes:
    """Read the samples back, checking the header."""
    riff, _, wave, _, _, kind, channels, _, _, _, bits, data, n = struct.unpack_from("<4sI4s4sIHHIIHH4sI", stored)
    if (riff, wave, kind, channels, bits, data) != (b"RIFF", b"WAVE", 1, 1, 8, b"data") or len(stored) != 44 + n:
        raise ValueError("not a stored media column")
    return stored[44:]


def cuts(data: bytes, least: int = 256, bits: int = 10, most: int = 8192) -> list[int]:
    """Ends of the chunks: where the gear hash of the last 32 bytes has `bits` leading zeros; between least and most."""
    n = len(data)
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the hash of 2k bytes from two of k bytes
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
    marks = np.flatnonzero(h < np.uint32(1 << (32 - bits))) + 1
    ends, at, i = [], 0, 0
    marks = marks.tolist()
    while at < n:
        while i < len(marks) and marks[i] < at + least:
            i += 1
        end = min(marks[i] if i < len(marks) else n, at + most, n)
        ends.append(end)
        at = end
    return ends


def chunks_of(payload: bytes) -> list[bytes]:
    at, out = 0, []
    for end in cuts(payload):
        out.append(payload[at:end])
        at = end
    return out


def digest_of(chunk: bytes) -> bytes:
    """128 bits name a chunk; the object's SHA-256 is checked as well when it is read back."""
    return hashlib.blake2b(chunk, digest_size=16).digest()


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("object", pa.binary()), ("digests", pa.list_(pa.binary()))])
STORE = pa.schema([("kind", pa.string()), ("object", pa.binary()), ("digests", pa.list_(pa.binary())), ("shared", pa.list_(pa.int32())), ("own", pa.binary()), ("digest", pa.binary()), ("chunk", pa.binary())])
STORE_DDL = "kind string, object binary, digests array<binary>, shared array<int>, own binary, digest binary, chunk binary"
READ = pa.schema([("object", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
READ_DDL = "object binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, object (SHA-256 of the WAV), digests in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                p, n = payload_of(t)
                stored = wav(p)
                rows.append((d, n, hashlib.sha256(stored).digest(), [digest_of(c) for c in chunks_of(stored)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, INDEX)], schema=INDEX)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, object binary, digests array<binary>")


def shared_keys(listed: DataFrame) -> DataFrame:
    """The keys of the digests that occur more than once in index()."""
    twice = listed.select(F.explode("digests").alias("d")).groupBy("d").agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.conv(F.hex(F.substring("d", 1, 8)), 16, -10).cast("long").alias("k"))


def write_store(docs: DataFrame, shared_digests: BitFilter) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored tables: objects that share nothing, objects that list shared chunks, and shared chunks; each once."""
    bits = docs.sparkSession.sparkContext.broadcast(shared_digests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(6)
        seen: set[bytes] = set()  # of this task, which saves work; Spark keeps one row of each below
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                rows = []
                for t in b.column(0).slice(at, 2000).to_pylist():
                    stored = wav(payload_of(t)[0])
                    name = hashlib.sha256(stored).digest()
                    if name in seen:
                        continue
                    parts = chunks_of(stored)
                    digests = [digest_of(c) for c in parts]
                    apart = np.flatnonzero(bits.value.has(np.array([key_of(d) for d in digests], np.int64))).tolist()
                    mine = set(apart)
                    own = z.compress(b"".join(struct.pack("<I", len(c)) + c for i, c in enumerate(parts) if i not in mine))
                    rows.append(("listed" if apart else "alone", name, digests, apart, own, None, None))
                    if apart:
                        seen.add(name)
                    for i in apart:
                        if digests[i] not in seen:
                            seen.add(digests[i])
                            rows.append(("chunk", None, None, None, None, digests[i], z.compress(parts[i])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), STORE)], schema=STORE)

    made: list[str] = []
    raw = cut(docs.select(F.col("text").cast("string")).mapInArrow(run, STORE_DDL), "media", made, by="kind")
    # two documents without a chunk in common are not equal, so objects that share nothing are there once
    listed = raw.where("kind = 'listed'").groupBy("object").agg(F.first(F.struct("digests", "shared", "own")).alias("o")).select("object", "o.*")
    chunks = raw.where("kind = 'chunk'").groupBy("digest").agg(F.first("chunk").alias("chunk"))
    with tidy(docs.sparkSession):
        listed, chunks = cut(listed, "media-listed"), cut(chunks, "media-chunks")
    drop(docs.sparkSession, [f"{made[0]}/kind={k}" for k in ("listed", "chunk")])
    return raw.where("kind = 'alone'").select("object", "digests", "shared", "own"), listed, chunks


def features(samples: bytes) -> str:
    x = np.frombuffer(samples, np.uint8)
    v = x.astype(np.int64)
    return f"mean={v.sum() / len(v):.6f};power={(v * v).sum() / len(v):.6f};min={v.min()};max={v.max()};steps={np.abs(np.diff(v)).sum()};kinds={len(np.unique(x))}"


def put_together(name: bytes, digests: list[bytes], shared: list[int], own: bytes, fetched: dict[int, bytes]) -> bytes:
    """The WAV of an object from its own chunks and the fetched ones; raises unless every digest holds."""
    z = zstandard.ZstdDecompressor()
    raw, at, parts = z.decompress(own), 0, []
    apart = set(shared)
    for i, d in enumerate(digests):
        if i in apart:
            c = z.decompress(fetched[i])
        else:
            (n,) = struct.unpack_from("<I", raw, at)
            c = raw[at + 4 : at + 4 + n]
            at += 4 + n
        if digest_of(c) != d:
            raise ValueError("a stored chunk does not match its digest")
        parts.append(c)
    stored = b"".join(parts)
    if hashlib.sha256(stored).digest() != name:
        raise ValueError("a stored object does not match its digest")
    return stored


def read_back(alone: DataFrame, listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each object, from the stored bytes alone."""
    wanted = listed.select("object", F.posexplode(F.transform("shared", lambda i: F.struct(i.alias("i"), F.get(F.col("digests"), i).alias("digest")))).alias("at", "s")).select("object", "s.i", "s.digest")
    fetched = wanted.join(chunks, "digest").groupBy("object").agg(F.collect_list(F.struct("i", "chunk")).alias("fetched"))
    rows = listed.join(fetched, "object").unionByName(alone, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                got = []
                for r in b.slice(at, 500).to_pylist():
                    stored = put_together(r["object"], r["digests"], r["shared"], r["own"], {f["i"]: f["chunk"] for f in r["fetched"] or ()})
                    back = wav_samples(stored)
                    got.append((r["object"], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), r["object"].hex(), features(back)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), READ)], schema=READ)

    return rows.select("object", "digests", "shared", "own", "fetched").mapInArrow(run, READ_DDL)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what read_back() says of the document's object, for every row of docs."""
    spark, made = docs.sparkSession, []
    whole = cut(index(docs), "media-index", made)
    with tidy(spark):
        shared = BitFilter.of(shared_keys(whole))
    listed = cut(whole.select("doc_id", "n_bytes", "object"), "media-objects")
    drop(spark, made)  # the digests of all chunks; the store has them again
    read = read_back(*write_store(docs, shared))
    return listed.join(read, "object").drop("object")


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
