"""Best-fit packing of tokenised documents by patterns.

Only the number of pieces of each length decides how well sequences fill, and there are at most `capacity` lengths. So
the driver sees a histogram alone: it enumerates patterns of a few lengths that fill a sequence, fits how often each is
used to the histogram by non-negative least squares, rounds down, and packs what is left best-fit decreasing. Pieces are
then dealt to the places of the plan by their rank among the pieces of their length. Ranks come from counts of each task,
so no length is gathered anywhere.

Edge cases: a null text counts as empty, which is the end token alone; a document longer than the capacity is cut into
full pieces, the first one shorter; rows with a repeated or null doc_id are packed one by one, each for itself; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself where it prints, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder(dict):
    """Ids as bytes of each space-separated stretch of a text, remembered up to a bound that only saves work.

    The byte-level tokenizer never merges across a space that a non-space follows, so a text's ids are those of its
    stretches. Its vocabulary numbers tokens in the order of its merges, so a new stretch can be merged by rank, which
    tiktoken does without the overhead of a full encoding; the file is checked for that order, and without it, or for
    texts with other runs of spaces or an added token's content, the tokenizer encodes.
    """

    LIMIT = 800_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.ranks = self.by_rank(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    @staticmethod
    def by_rank(path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre = file["model"], file["pre_tokenizer"] or {}
        symbols = byte_symbols()
        added = {t["content"] for t in file.get("added_tokens", [])}
        tokens = [t for t in model.get("vocab", ()) if t not in added]
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", ())]
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and file["normalizer"] is None
        if not plain or len(tokens) != 256 + len(merged) or any(model["vocab"][m] != 256 + i for i, m in enumerate(merged)) or any(c not in symbols for t in tokens for c in t):
            return None
        ranks = {bytes(symbols[c] for c in t): model["vocab"][t] for t in tokens}
        # Fixed value: the byte-level pre-tokenizer's pattern.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def first(self, stretch: str) -> bytes:
        return array("I", self.ranks(stretch)).tobytes() if self.ranks else self.whole(stretch)

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= self.LIMIT:
            self.clear()
        ids = self[stretch] = self.first(" " + stretch)
        return ids

    def encode(self, text: str) -> bytes:
        s = text.split(" ")
        if "" in s or any(a in text for a in self.added):
            return self.whole(text)
        return self.first(s[0]) + b"".join(map(self.__getitem__, s[1:]))


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document of n ids: full pieces, the first shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def nnls(a: np.ndarray, b: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Non-negative least squares by coordinate descent on the normal equations."""
    g, x = a.T @ a, np.zeros(a.shape[1])
    r = a.T @ b
    diag = np.maximum(g.diagonal(), 1e-9)
    grad = -r
    for _ in range(sweeps):
        for j in range(len(x)):
            new = max(0.0, x[j] - grad[j] / diag[j])
            if new != x[j]:
                grad += g[:, j] * (new - x[j])
                x[j] = new
    return x


def patterns(hist: np.ndarray, per_length: int = 2) -> list[tuple[int, ...]]:
    """Few-document patterns that fill a sequence: the full one, exact pairs, and for each long length the triples and
    quadruples whose rest is filled by lengths that are common."""
    cap = len(hist) - 1
    have = np.flatnonzero(hist)
    out: set[tuple[int, ...]] = set()
    common = have[np.argsort(-hist[have], kind="stable")]
    for a in map(int, have):
        if a == cap:
            out.add((a,))
        elif cap - a <= a and hist[cap - a]:
            out.add((a, cap - a))
        rest = cap - a
        found = 0
        for b in map(int, common):
            c = rest - b
            if b >= c >= 1 and b <= a and hist[c]:
                out.add((a, b, c))
                found += 1
            elif c > 1 and b <= a and c // 2 <= b and hist[c // 2] and hist[c - c // 2]:
                out.add(tuple(sorted((a, b, c // 2, c - c // 2), reverse=True)))
                found += 1
            if found >= per_length:
                break
    return sorted(out, reverse=True)


def fitted(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how often each is used, by non-negative least squares, rounded down; at most what the histogram has."""
    cap, choices = len(hist) - 1, patterns(hist)
    if not choices:
        return []
    a = np.zeros((cap + 1, len(choices)))
    for j, p in enumerate(choices):
        np.add.at(a[:, j], list(p), 1)
    scale = max(float(hist.max()), 1.0)
    x = np.floor(nnls(a, hist / scale) * scale + 1e-6).astype(np.int64)
    left, out = hist.copy(), []
    for j in np.argsort(-x, kind="stable"):
        need = np.bincount(choices[j], minlength=cap + 1)
        used = np.flatnonzero(need)
        if (k := int(min(x[j], (left[used] // need[used]).min()))) > 0:
            out.append((choices[j], k))
            left -= k * need
    return out


def best_fit(hist: np.ndarray, done: dict[tuple[int, ...], int]) -> None:
    """Add to done what packs the histogram, longest first, into the fullest sequence with room; like ones together."""
    cap = len(hist) - 1
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for n in range(cap, 0, -1):
        c = int(hist[n])
        while c:
            room = next((r for r in range(n, cap) if bins.get(r)), None)
            if room is None:
                p = ()
                m = min(cap // n, c)
                k = c // m
            else:
                p = next(iter(bins[room]))
                m = min(room // n, c)
                k = min(bins[room][p], c // m)
                bins[room][p] -= k
                if not bins[room][p]:
                    del bins[room][p]
            q = p + (n,) * m
            rest = cap - sum(q)
            bins[rest][q] = bins[rest].get(q, 0) + k
            c -= k * m
    for kinds in bins.values():
        for p, k in kinds.items():
            done[p] += k


def plan(hist: np.ndarray, shares: tuple[float, ...] = (1.0, 0.9, 0.7, 0.4, 0.0)) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every piece of the histogram once; patterns list lengths in order of their places.

    Fitted patterns can use up the short lengths that the rest needs, so several shares of them are tried.
    """
    hist = hist.astype(np.int64)
    found, best = fitted(hist), None
    for share in shares if found else (0.0,):
        done: dict[tuple[int, ...], int] = defaultdict(int)
        left = hist.copy()
        for p, k in found:
            if used := int(k * share):
                done[p] += used
                np.subtract.at(left, list(p), used)
        best_fit(left, done)
        if best is None or sum(done.values()) < sum(best.values()):
            best = done
    return sorted((p, k) for p, k in best.items() if k)[::-1]


def places(planned: list[tuple[tuple[int, ...], int]], cap: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by rank: first rank of a run, the run's first sequence, and the place in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for p, k in planned:
        offset = 0
        for n in p:
            runs[n].append((taken[n], base, offset))
            taken[n] += k
            offset += n
        base += k
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def tokenized_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Every piece with its task and its rank among the task's pieces of its length."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                rows = []
                for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(t or "") + tail
                    for i, (s, n) in enumerate(pieces_of(len(ids) // 4, capacity)):
                        rows.append((d, i, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), task, int(seen[n])))
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES)], schema=PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    The pieces are written before they are ranked, so ranks do not change if a task is run again.
    """
    from pyspark.sql import Window

    pieces = cut(tokenized_pieces(docs, tokenizer, end_id, capacity), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # at most `capacity` rows reach the driver
    hist = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        hist[r.length] = r.n
    where = docs.sparkSession.sparkContext.broadcast(places(plan(hist), capacity))
    before = by_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.join(before.select("task", "length", F.coalesce("before", F.lit(0)).alias("before")), ["task", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for length in np.unique(n):
                at = n == length
                first, base, offset = where.value[int(length)]
                i = np.searchsorted(first, rank[at], "right") - 1
                seq[at], off[at] = base[i] + rank[at] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], schema=out)

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_pattern_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
