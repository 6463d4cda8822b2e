"""Approximate nearest neighbours by additive quantisation.

A vector is coded as the sum of one word from each of several full-dimensional codebooks. The codebooks are fitted to
the residuals of a bounded sample and refitted together by least squares; a beam search finds the words of a vector.
The index holds each vector's words, the stored norm of their sum, and the vector. A query's inner products with all
words are a lookup table; adding up the table's entries for a row and dividing by the stored norm gives its approximate
cosine. Each shard keeps the best rows by that score and reranks them by the exact cosine.

Queries meet the rows in blocks: rows lie in shards, and a task holds one shard while the queries stream past it in
blocks of bounded size; Spark sorts them behind the shard's rows. So neither side is held whole, and no row is repeated.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part;
a query does not find its own row, nor other rows of its id; with fewer candidates than k all are returned; ties go to
the smaller vec_id; repeated rows are candidates one by one; as queries, rows of one id and vector are one, and rows of
one id with different vectors each get their ranks; without any vector the result is empty; extra columns are ignored.

Cost: every query meets every row's codes, so work grows with queries times rows; shards bound a task's memory alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 7


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (c @ x.T - 0.5 * (c * c).sum(1)[:, None]).argmax(0)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Words (rows x books) whose sum is near each row; `beam` partial sums are kept after each book."""
    n, (m, k, _) = len(x), books.shape
    codes, sums = np.zeros((n, 1, 0), np.int16), np.zeros((n, 1, x.shape[1]))
    for j in range(m):
        b = books[j]
        # squared error after adding a word: |s|^2 + |b|^2 + 2 s.b - 2 x.s - 2 x.b, up to |x|^2
        err = ((sums * sums).sum(2) - 2 * (sums * x[:, None]).sum(2))[:, :, None] + (b * b).sum(1) + 2 * (sums - x[:, None]) @ b.T
        width = min(beam, err.shape[1] * k)
        flat = err.reshape(n, -1)
        best = np.argpartition(flat, width - 1, 1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
        row = np.arange(n)[:, None]
        best = best[row, np.argsort(flat[row, best], 1, kind="stable")]
        old, word = best // k, best % k
        codes = np.concatenate([codes[row, old], word[:, :, None].astype(np.int16)], 2)
        sums = sums[row, old] + b[word]
    return codes[:, 0]


def fit(x: np.ndarray, books: int = 16, words: int = 64, beam: int = 4, passes: int = 2) -> np.ndarray:
    """Codebooks (books x words x dims) for rows of unit length."""
    rng = np.random.default_rng(SEED)
    words = max(1, min(words, len(x)))
    rest, out = x.copy(), []
    for _ in range(books):
        c = kmeans(rest, words, 10, rng)
        rest = rest - c[(c @ rest.T - 0.5 * (c * c).sum(1)[:, None]).argmax(0)]
        out.append(c)
    c = np.stack(out)
    for _ in range(passes):  # all words anew by ridge regression on the beam's codes
        codes = beam_encode(x, c, beam).astype(np.int64) + np.arange(books) * words
        a = np.zeros((len(x), books * words))
        np.put_along_axis(a, codes, 1.0, 1)
        c = np.linalg.solve(a.T @ a + 0.05 * np.eye(books * words), a.T @ x + 0.05 * c.reshape(books * words, -1)).reshape(c.shape)
    return c


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector as doubles, without vectors that take no part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where(good)
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("v") == (dims.d if dims else 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def build_index(v: DataFrame, sample: int = 8192, beam: int = 4, **sizes) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, codes, norm) for every row of v, and the codebooks, fitted to at most `sample` rows."""
    got = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    books = fit(unit(np.stack(got.v)), beam=beam, **sizes) if len(got) else np.zeros((1, 1, 1))
    shared = v.sparkSession.sparkContext.broadcast(books)

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 1024):
                q = p.iloc[at : at + 1024]
                codes = beam_encode(unit(np.stack(q.v)), shared.value, beam)
                total = shared.value[np.arange(codes.shape[1]), codes].sum(1)
                yield q.assign(codes=[c.astype("<i2").tobytes() for c in codes], norm=np.linalg.norm(total, axis=1))

    return v.mapInPandas(encode, "vec_id long, v array<double>, codes binary, norm double"), books


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, on the vectors as given."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
    odd = ~np.isfinite(out)
    if odd.any():  # squares beyond the range of doubles: scale first
        out[odd] = np.einsum("ij,ij->i", unit(a[odd]), unit(b[odd]))
    return out


def search_shard(rows: pd.DataFrame, queries: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], books: np.ndarray, k: int, rerank: float) -> Iterator[pd.DataFrame]:
    """For each block of queries, their best k rows of a shard: approximate scores by lookup, exact cosine for the best share `rerank` of the vectors."""
    rows = rows.sort_values("vec_id", kind="stable")
    ids, v = rows.vec_id.to_numpy(), np.stack(rows.v)
    # equal vectors: one entry each; only the first k + 1 ids of an entry can be among a query's k nearest
    _, first, entry = np.unique(v, axis=0, return_index=True, return_inverse=True)
    entry = entry.ravel()
    order = np.argsort(entry, kind="stable")
    start = np.searchsorted(entry[order], np.arange(len(first) + 1))
    codes = np.stack([np.frombuffer(c, "<i2") for c in rows.codes.to_numpy()[first]]).astype(np.int64)
    norm = np.maximum(rows.norm.to_numpy()[first], 1e-12)
    own = v[first]
    for qid, key, q in queries:
        out = []
        table = np.einsum("qd,mkd->qmk", unit(q), books)
        approx = np.zeros((len(q), len(first)))
        for m in range(len(books)):
            approx += table[:, m, codes[:, m]]
        approx /= norm
        r = min(max(int(rerank * len(first)), 64), len(first))
        best = np.argpartition(-approx, r - 1, 1)[:, :r] if r < len(first) else np.tile(np.arange(r), (len(q), 1))
        for i in range(len(q)):
            s = cosine(np.broadcast_to(q[i], (r, q.shape[1])), own[best[i]])
            top = np.argsort(-s, kind="stable")
            kth = s[top[min(k, r - 1)]]
            hit = [(ids[x], s[t]) for t in top if s[t] >= kth for x in [y for y in order[start[best[i][t]] : start[best[i][t] + 1]] if ids[y] != qid[i]][:k]]
            hit.sort(key=lambda h: (-h[1], h[0]))
            out += [(qid[i], key[i], h[0], h[1]) for h in hit[:k]]
        yield pd.DataFrame(out, columns=["query_id", "query", "vec_id", "score"])


def search_sorted(parts: Iterator[pd.DataFrame], books: np.ndarray, k: int, rerank: float, block: int) -> Iterator[pd.DataFrame]:
    """search_shard for the shards of a partition that holds each shard's rows (asks = 0) and then its queries (asks = 1).

    One shard and one part of the queries are in memory at a time.
    """

    def runs() -> Iterator[tuple[int, int, pd.DataFrame]]:
        for p in parts:
            key = p.shard.to_numpy() * 2 + p.asks.to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(p)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    yield int(p.shard.iloc[a]), int(p.asks.iloc[a]), p.iloc[a:b]

    def blocks(group: Iterator[tuple[int, int, pd.DataFrame]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, _, p in group:
            for i in range(0, len(p), block):
                q = p.iloc[i : i + block]
                yield q.vec_id.to_numpy(), q["query"].to_numpy(), np.stack(q.v)

    rows: tuple[int, pd.DataFrame] | None = None
    for (shard, asks), group in groupby(runs(), lambda x: x[:2]):
        if not asks:
            rows = shard, pd.concat([p for _, _, p in group])
        elif rows is not None and rows[0] == shard:  # a shard can be empty
            yield from search_shard(rows[1], blocks(group), books, k, rerank)


def search(vectors: DataFrame, is_query, k: int = 5, rerank: float = 0.1875, shard_rows: int = 8192, block: int = 64, **sizes) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds.

    A shard holds about shard_rows rows; their number alone decides how many there are, so settings do not change results.
    """
    v = usable(vectors)
    index, books = build_index(v, **sizes)
    shared = v.sparkSession.sparkContext.broadcast(books)
    shards = max(1, -(-v.count() // shard_rows))
    rows = index.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(shards)))
    # several rows of an id and vector are one query
    asked = v.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("query", F.xxhash64("v")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    nothing = (F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("norm"))
    both = rows.select("vec_id", "v", "codes", "norm", "shard", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("query")).union(asked.select("vec_id", "v", *nothing, "shard", F.lit(1).alias("asks"), "query"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return search_sorted(parts, shared.value, k, rerank, block)

    parts = both.repartition("shard").sortWithinPartitions("shard", "asks").mapInPandas(run, "query_id long, query long, vec_id long, score double")
    by_query = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
