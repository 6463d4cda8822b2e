"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. A line's features are taken from its own text and from the lines before and after it. The
forward-backward pass gives each line's probability of being good; the mean, weighted by line length, is the
document's quality. Training marks every line of a labelled document with the document's label.

Edge cases: a null text counts as empty; an empty text has one empty line; a null doc_id keeps its row and is never
trained on; extra columns are ignored; an empty table or labels of one class only give the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

SYMBOLS = b"#$%&*|<>{}[]\\^~=_+@!"
DIGITS = b"0123456789"
N_OWN = 11
N_FEATURES = 3 * N_OWN + 3
#: Lines longer than this are read in pieces of this many words, so that a page without line ends has a chain too.
PIECE = 64
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def pieces(text: str) -> list[list[str]]:
    """The lines of a text as word lists; long lines in pieces. Every word is in exactly one."""
    out = []
    for line in text.split("\n"):
        words = line.split()
        out += [words[i : i + PIECE] for i in range(0, len(words), PIECE)]
    return out or [[]]


def own_features(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_OWN features, lengths in bytes)."""
    x, size = np.zeros((len(lines), N_OWN)), np.zeros(len(lines))
    for i, words in enumerate(lines):
        s = "".join(words).encode(errors="replace")
        n, k = len(s), len(words)
        size[i] = n + k
        if not n:
            x[i, 10] = 1
            continue
        sym = (n - len(s.translate(None, SYMBOLS))) / n
        upper = sum(map(str.isupper, words)) / k
        uniq = len(set(words)) / k
        same = sum(map(eq, words, words[1:])) / max(k - 1, 1)
        digits = (n - len(s.translate(None, DIGITS))) / n
        x[i] = (sym, sym > 0.05, sym > 0.15, upper, upper > 0.4, 1 - uniq, same, same > 0.3, digits, min(k, PIECE) / PIECE, 0)
    return x, size


def features(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Own features with those of the line before and after, flags for the ends, and a constant."""
    x, size = own_features(lines)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    ends = np.zeros((len(x), 3))
    ends[0, 0] = ends[-1, 1] = 1
    ends[:, 2] = 1
    return np.hstack([x, before, after, ends]), size


def chains(emit: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once, which advance together, longest first.

    Gives P(label) of each line, summed P(pair) over the transitions, and the log partition of each chain.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[start] = emit[start]
    steps = int(length[0]) if len(length) else 0
    alive = [int(np.searchsorted(-length, -i, "left")) for i in range(steps)]  # chains with more than i lines
    for i in range(1, steps):
        at = start[: alive[i]] + i
        p = a[at - 1][:, :, None] + trans
        a[at] = emit[at] + np.logaddexp(p[:, 0], p[:, 1])
    for i in range(steps - 2, -1, -1):
        at = start[: alive[i + 1]] + i
        p = trans[None] + (emit[at + 1] + b[at + 1])[:, None, :]
        b[at] = np.logaddexp(p[:, :, 0], p[:, :, 1])
    last = start + length - 1
    z = np.empty(len(length))
    z[order] = np.logaddexp(a[last, 0], a[last, 1])
    zl = np.full(len(emit), np.inf)
    chain_of = np.repeat(np.arange(len(length)), length)
    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(start, length)]) if len(length) else np.empty(0, int)
    zl[rows] = z[order][chain_of]
    mid = np.setdiff1d(rows, last, assume_unique=True)
    pair = np.exp(a[mid][:, :, None] + trans + (emit[mid + 1] + b[mid + 1])[:, None, :] - zl[mid][:, None, None]).sum(0) if len(mid) else np.zeros((2, 2))
    return np.exp(a + b - zl[:, None]), pair, z


def fit(docs: list[tuple[str, int]], steps: int = 120, l2: float = 1e-3) -> dict:
    """Maximise the conditional likelihood of the line labels with Adam on full gradients; then place the threshold."""
    if len({y for _, y in docs}) < 2:
        prior = float(docs[0][1]) if docs else 0.5
        return {"w": np.zeros((N_FEATURES, 2)), "t": np.zeros((2, 2)), "a": 0.0, "b": 4.0 if prior == 1 else -4.0 if docs else 0.0}
    feats = [features(pieces(t)) for t, _ in docs]
    x = np.vstack([f for f, _ in feats])
    size = np.concatenate([s for _, s in feats])
    length = np.array([len(f) for f, _ in feats])
    start = np.cumsum(length) - length
    doc_y = np.array([y for _, y in docs])
    y = np.repeat(doc_y, length)
    weight = np.where(doc_y == 1, 0.5 / max(doc_y.mean(), 1e-9), 0.5 / max(1 - doc_y.mean(), 1e-9))  # both classes count alike
    wl = np.repeat(weight, length)
    total = wl.sum()
    groups = [np.flatnonzero(doc_y == k) for k in (0, 1)]
    one = np.eye(2)[y]
    seen = np.zeros((2, 2))
    for k in (0, 1):
        seen[k, k] = (weight * (length - 1))[doc_y == k].sum()
    w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    ms, vs = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1):
        emit, p, pair = x @ w, np.zeros((len(x), 2)), np.zeros((2, 2))
        for own in groups:
            q, pr, _ = chains(emit, start[own], length[own], t)
            rows = np.repeat(doc_y == doc_y[own[0]], length)
            p[rows] = q[rows]
            pair += weight[own[0]] * pr
        grads = [x.T @ ((one - p) * wl[:, None]) / total - l2 * w, (seen - pair) / total - l2 * t]
        for v, g, m, s in zip((w, t), grads, ms, vs):
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            v += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    p, _, _ = chains(x @ w, start, length, t)
    q = np.add.reduceat(p[:, 1] * size, start) / np.maximum(np.add.reduceat(size, start), 1e-9)
    # one-variable logistic regression places 0.5 between the classes, each counted alike
    a, b = 8.0, -4.0
    for _ in range(300):
        e = (1 / (1 + np.exp(-(a * q + b))) - doc_y) * weight
        h = np.array([[(weight * q * q).mean(), (weight * q).mean()], [(weight * q).mean(), weight.mean()]]) * 0.25 + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, [(e * q).mean() + 1e-3 * a, e.mean() + 1e-3 * b])
    return {"w": w, "t": t, "a": float(a), "b": float(b)}


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    feats = [features(pieces(t or "")) for t in texts]
    if not feats:
        return np.empty(0)
    length = np.array([len(f) for f, _ in feats])
    start = np.cumsum(length) - length
    size = np.concatenate([s for _, s in feats])
    p, _, _ = chains(np.vstack([f for f, _ in feats]) @ model["w"], start, length, model["t"])
    total = np.add.reduceat(size, start)
    plain = np.add.reduceat(p[:, 1], start) / length
    q = np.where(total > 0, np.add.reduceat(p[:, 1] * size, start) / np.maximum(total, 1e-9), plain)
    return 1 / (1 + np.exp(-(model["a"] * q + model["b"])))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, held_mod: int = 3, held_rest: int = 1) -> dict:
    """Fit on at most max_docs labelled rows outside the held-out fold, half of each label, chosen by a hash of the id."""
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(f"y in (0, 1) and doc_id is not null").where(crc_mod("doc_id", held_mod) != held_rest).distinct()
    pick = [lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2) for y in (0, 1)]
    pick = cut(pick[0].union(pick[1]), "quality-sample")
    # at most max_docs rows: bounded by the two limits above, one text for each id and label
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy("doc_id", "y", "text").collect()
    return fit([(r.text, r.y) for r in got])


def score(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, held_mod: int = 3, held_rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_docs, held_mod, held_rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), model.value))], schema=OUT)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", held_mod) == held_rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs, with all their columns, whose score is 0.5 or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.filter(pa.array(score_texts(part.column(column).to_pylist(), shared.value) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op3_quality_crf(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
