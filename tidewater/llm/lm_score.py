"""Cross-entropy difference between a target and a background bigram model.

Both models have the same order, smoothing and vocabulary, which is every word of the documents. The target model is
counted on the target texts, the background model on every document. A document's score is its mean loss per token under
the target model less that under the background model; the lower, the more the document is like the target.

    P(w | v) = (c(v w) + mu * P(w)) / (c(v) + mu)
    P(w) = (c(w) + nu * B(w)) / (N + nu),   B(w) = the word's share of the documents' words

The end of a text counts as an event after its last word, but is not scored. For the background P(w) is B(w).

Counts are never gathered in one place. A task counts the words and pairs of a flush of documents, names them by 56-bit
hashes and sends the sorted counts, packed, to the range of hashes they fall in; so a word that is everywhere costs one
entry a flush. A range adds up what the flushes say and answers each with the totals in the order it asked. The flush's
words come along as numbers, from which the same hashes are made again, and its documents are scored.

Edge cases: a null or empty text has no tokens, its losses and score are 0; rows with a null or repeated doc_id are
scored one by one; without target texts all scores come from B alone; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Hashes, mix, pack, parts_of, sized, spread, squeeze, unpack

BITS = 56
#: Tokens that a task counts at a time.
FLUSH = 800_000
#: The start of a text; hashes of words have 63 bits.
START = np.uint64((1 << 64) - 1)
ROWS = pa.schema([("range", pa.int32()), ("side", pa.int32()), ("flush", pa.int64()), ("blob", pa.binary())])
TOTALS = [("target", "<u8"), ("background", "<u8")]


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space; A-Z in lower case."""
    return (text or "").encode(errors="replace").lower().split()


def n_words(docs: DataFrame) -> int:
    n = F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]


class Flush:
    """Words and pairs of some texts: `word` holds the different words' hashes, `at` each token's place there."""

    def __init__(self, word: np.ndarray, at: np.ndarray, n: np.ndarray):
        self.at, self.filled = at, n > 0
        self.first = (np.cumsum(n) - n)[self.filled]
        start = len(word)
        self.prev = np.concatenate([[start], at[:-1]])[: len(at)]
        self.prev[self.first] = start
        word = np.append(word, START)
        pair, self.pair = np.unique(mix(word[self.prev] * np.uint64(0x9E3779B97F4A7C15) + word[at]), return_inverse=True)
        self.words = len(word)
        keys = np.concatenate([mix(word), pair]) >> np.uint64(64 - BITS)
        counts = np.concatenate([np.bincount(at, minlength=start), [len(self.first)], np.bincount(self.pair, minlength=len(pair))])
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.counts = keys[self.order], counts[self.order].astype("<u4")

    def losses(self, totals: np.ndarray, n_target: int, n_background: int, mu: float, nu: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each filled text under the target and the background model, from the totals of the keys."""
        t, b = np.empty(len(totals)), np.empty(len(totals))
        t[self.order], b[self.order] = totals["target"], totals["background"]
        share = b[: self.words] / max(n_background, 1)
        out = []
        for c, p in ((t, (t[: self.words] + nu * share) / (n_target + nu)), (b, share)):
            x = -np.log((c[self.words :][self.pair] + mu * p[self.at]) / (c[self.prev] + mu))
            out.append(np.add.reduceat(x, self.first))
        return out[0], out[1]


def packed_counts(docs: DataFrame, side: int, ranges: int) -> DataFrame:
    """(range, side, flush, blob): counts of each flush by range; and, with a negative range, the documents of side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, task, number = Hashes(), TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                texts.append(hashes.of(words(t)))
                size += len(texts[-1])
                if size > FLUSH:
                    yield from sent(ids, texts, task << 24 | number)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from sent(ids, texts, task << 24 | number)

    def sent(ids: list, texts: list[np.ndarray], flush: int) -> Iterator[pa.RecordBatch]:
        n = np.array([len(t) for t in texts], np.int64)
        word, at = np.unique(np.concatenate(texts), return_inverse=True)
        rows = []
        if side:
            known = np.array([i is not None for i in ids])
            doc = np.array([0 if i is None else i for i in ids], np.int64)
            rows.append((-1 - ((flush >> 24) + (flush & 0xFFFFFF)) % ranges, side, flush, sized(squeeze(doc), squeeze(known.astype(np.uint8)), squeeze(n), pack(word), squeeze(at.astype("<u4")))))
        f = Flush(word, at, n)
        step = (1 << BITS) // ranges + 1
        edge = np.searchsorted(f.keys, np.arange(ranges + 1, dtype=np.uint64) * np.uint64(step))
        for r in np.flatnonzero(np.diff(edge)):
            part = slice(edge[r], edge[r + 1])
            rows.append((int(r), side, flush, sized(pack(f.keys[part]), squeeze(f.counts[part]))))
        for i in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 256]), ROWS)], schema=ROWS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "range int, side int, flush long, blob binary")


def added_up(counts: DataFrame) -> DataFrame:
    """(flush, range, blob): the totals of a flush's keys of each range, in the order of the keys; and its documents."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        if p.range.iloc[0] < 0:
            return p[["flush", "range", "blob"]]
        both = [parts_of(b) for b in p.blob]
        keys = [unpack(k) for k, _ in both]
        n = np.concatenate([spread(c, "<u4") for _, c in both]).astype(np.float64)  # whole numbers below 2^53
        edge = np.cumsum([0, *map(len, keys)])
        side = np.repeat(p.side.to_numpy(), np.diff(edge))
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        table = np.empty(len(at), TOTALS)
        for k, name in enumerate(("target", "background")):
            table[name] = np.bincount(at, n * (side == k))[at]
        out = [(f, r, squeeze(table[edge[i] : edge[i + 1]])) for i, (f, r, s) in enumerate(zip(p.flush, p.range, p.side)) if s]
        return pd.DataFrame(out, columns=["flush", "range", "blob"])

    return counts.groupBy("range").applyInPandas(run, "flush long, range int, blob binary")


def score(docs: DataFrame, target: DataFrame, mu: float = 10.0, nu: float = 1000.0) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background, score for every row of docs."""
    conf = docs.sparkSession.conf
    ranges = max(8 * docs.rdd.getNumPartitions(), 4 * int(conf.get("spark.sql.shuffle.partitions")), 16)
    n_target, n_background = n_words(target), n_words(docs)
    sides = packed_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), 0, ranges).union(packed_counts(docs, 1, ranges))

    def by_flush(p: pd.DataFrame) -> pd.DataFrame:
        doc, known, n, word, at = parts_of(p.blob[p.range < 0].iloc[0])
        n, known = spread(n, np.int64), spread(known, np.uint8).astype(bool)
        f = Flush(unpack(word), spread(at, "<u4").astype(np.int64), n)
        lt, lb = np.zeros(len(n)), np.zeros(len(n))
        if len(f.at):
            totals = np.concatenate([spread(b, TOTALS) for b in p[p.range >= 0].sort_values("range").blob])
            lt[f.filled], lb[f.filled] = f.losses(totals, n_target, n_background, mu, nu)
        size = np.maximum(n, 1)
        ids = pd.array(spread(doc, np.int64), dtype="Int64")
        ids[~known] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_tokens": n, "loss_target": lt / size, "loss_background": lb / size})

    out = added_up(sides).groupBy("flush").applyInPandas(by_flush, "doc_id long, n_tokens long, loss_target double, loss_background double")
    return out.withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op4_cross_entropy_difference(spark, sf_dir: str) -> DataFrame:
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


OP4_SQL = r"""
WITH tw AS (SELECT item_id AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w,
                   generate_subscripts(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 1) AS i FROM benchmark),
dw AS (SELECT doc_id AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w,
                   generate_subscripts(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), 1) AS i FROM documents),
t AS (SELECT d, w, lag(w, 1, '') OVER (PARTITION BY d ORDER BY i) AS v FROM tw),
b AS (SELECT d, w, lag(w, 1, '') OVER (PARTITION BY d ORDER BY i) AS v FROM dw),
t2 AS (SELECT v, w, count(*) AS n FROM t GROUP BY v, w), b2 AS (SELECT v, w, count(*) AS n FROM b GROUP BY v, w),
tc AS (SELECT w, count(*) AS n FROM t GROUP BY w UNION ALL SELECT '', count(*) FROM t WHERE v = ''),
bc AS (SELECT w, count(*) AS n FROM b GROUP BY w UNION ALL SELECT '', count(*) FROM b WHERE v = ''),
tn AS (SELECT count(*) AS n FROM t), bn AS (SELECT count(*) AS n FROM b),
pairs AS (SELECT b2.v, b2.w,
  -ln((coalesce(t2.n, 0) + 10.0::double * ((coalesce(tw.n, 0) + 1000.0::double * (bw.n / bn.n::double)) / (tn.n + 1000.0::double))) / (coalesce(tv.n, 0) + 10.0::double)) AS lt,
  -ln((b2.n + 10.0::double * (bw.n / bn.n::double)) / (bv.n + 10.0::double)) AS lb
  FROM b2 JOIN bc bw ON bw.w = b2.w JOIN bc bv ON bv.w = b2.v LEFT JOIN t2 ON t2.v = b2.v AND t2.w = b2.w LEFT JOIN tc tw ON tw.w = b2.w LEFT JOIN tc tv ON tv.w = b2.v, tn, bn),
s AS (SELECT d, count(*) AS n, sum(lt) / count(*) AS lt, sum(lb) / count(*) AS lb FROM b JOIN pairs USING (v, w) GROUP BY d)
SELECT doc_id, coalesce(s.n, 0)::bigint AS n_tokens, round(coalesce(lt, 0.0), 6) AS loss_target, round(coalesce(lb, 0.0), 6) AS loss_background, round(coalesce(lt - lb, 0.0), 6) AS score
FROM documents LEFT JOIN s ON s.d = documents.doc_id
"""
