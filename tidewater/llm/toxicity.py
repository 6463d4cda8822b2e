"""Toxicity from two class-conditional Kneser-Ney models.

Expressions are spelled words: a word's probability is the product over its characters, each given the characters
before it in the word, so inflected and compound forms of an expression share their stem's evidence. Each class
discounts its own counts of the longest context and backs off to one distribution that both classes share, built from
the pooled continuation counts of the shorter contexts; what is too rare to tell the classes apart gets nearly the same
probability from both.

A toxic text is mostly ordinary: each of its words comes from the toxic model with a small chance `share`, and from the
ordinary model else. A document's score is a logistic function of the difference of the two log-likelihoods of all its
words, the toxic and the ordinary one, divided by the number of words. With the plain toxic model instead of the mixture
the few toxic words drown in the chance differences of all others (README).

Edge cases: a null or empty text has no words, its difference is 0; a null doc_id keeps its row and is never trained
on; extra columns are ignored; without both classes the score is the prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut

#: The chance of a toxic text's word to come from the toxic model: the one that parts the classes best over the folds that
#: the models are not fitted on. 1 is the plain toxic model.
SHARES = (0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.3, 1.0)
SHARE = 0.02
EDGE = ".,;:!?\"'()[]{}*#$%&|-_"
OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def words(text: str) -> list[str]:
    """What stands between white space, in lower case and without punctuation at its ends."""
    return [w for w in (x.strip(EDGE) for x in text.lower().split()) if w]


START, END = "\x02", "\x03"


def spelled(word: str, order: int) -> Iterator[str]:
    """The runs of `order` characters that end in each character of a padded word."""
    s = START * (order - 1) + word + END
    return (s[i : i + order] for i in range(len(s) - order + 1))


def gram_counts(docs: list[list[str]], order: int) -> Counter[str]:
    """How often each run of characters ends in a character of the words."""
    out: Counter[str] = Counter()
    for w, n in Counter(w for d in docs for w in d).items():
        for g in spelled(w, order):
            out[g] += n
    return out


class KneserNey:
    """The two classes' models of a word's next character, with one backoff for both, from their gram_counts()."""

    BACKOFF_DISCOUNT = 0.75

    def __init__(self, toxic: Counter[str], ordinary: Counter[str], order: int, discount: float):
        self.order, self.discount, self.counts = order, discount, [toxic, ordinary]
        pooled = self.counts[0] + self.counts[1]
        # shared continuation counts: in how many different longer runs a shorter run ends
        self.shared: list[Counter[str]] = [Counter()] * order
        longer = pooled
        for k in range(order - 1, 0, -1):
            longer = self.shared[k] = Counter(g[1:] for g in longer)
        self.total: list[Counter[str]] = [Counter() for _ in range(order)]
        self.kinds: list[Counter[str]] = [Counter() for _ in range(order)]
        for k in range(1, order):
            for g, n in self.shared[k].items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1
        self.letters = len(self.shared[1]) + 1  # one for all that was never seen
        self.known: dict[str, float] = {}
        # what the discount leaves of a context's counts: for each class, and as a share of the pooled counts
        self.mass: list[Counter[str]] = [Counter(), Counter()]
        for c, m in zip(self.counts, self.mass):
            for g, n in c.items():
                m[g[:-1]] += max(n - discount, 0)
        context: Counter[str] = Counter()
        kept: Counter[str] = Counter()
        for g, n in pooled.items():
            context[g[:-1]] += n
            kept[g[:-1]] += max(n - discount, 0)
        self.to_backoff = {h: 1 - kept[h] / n for h, n in context.items()}

    def back(self, g: str) -> float:
        """The shared probability of the last character of g after the ones before it."""
        if not g:
            return 1 / self.letters
        p = self.known.get(g)
        if p is None:
            k, h, d = len(g), g[:-1], self.BACKOFF_DISCOUNT
            n, shorter = self.total[k][h], self.back(g[1:])
            p = self.known[g] = (max(self.shared[k][g] - d, 0) + d * self.kinds[k][h] * shorter) / n if n else shorter
        return p

    def probability(self, side: int, g: str) -> float:
        """P(last character of g | the ones before it) of a class: 0 toxic, 1 ordinary."""
        h, b = g[:-1], self.back(g[1:])
        if not self.mass[side][h]:
            return b
        lam = self.to_backoff[h]
        return (1 - lam) * max(self.counts[side][g] - self.discount, 0) / self.mass[side][h] + lam * b

    def ratios(self) -> LogRatios:
        seen = {}
        for g in self.counts[0].keys() | self.counts[1].keys():
            if r := float(np.log(self.probability(0, g) / self.probability(1, g))):
                seen[g] = r
        # a character that no class has seen after a context: only a class with counts there backs off at a cost
        new = {h: float(np.log(lam) if self.mass[0][h] else -np.log(lam)) for h, lam in self.to_backoff.items() if bool(self.mass[0][h]) != bool(self.mass[1][h])}
        return LogRatios(seen, new, self.order)


class LogRatios(dict):
    """word -> log P(word | toxic) - log P(word | ordinary), remembered up to a bound that only saves work."""

    LIMIT = 300_000

    def __init__(self, seen: dict[str, float], new: dict[str, float], order: int):
        super().__init__()
        self.seen, self.new, self.order = seen, new, order

    def __missing__(self, word: str) -> float:
        if len(self) >= self.LIMIT:
            self.clear()
        r = 0.0
        for g in spelled(word, self.order):
            x = self.seen.get(g)
            r += self.new.get(g[:-1], 0.0) if x is None else x
        self[word] = r
        return r

    def __reduce__(self):
        return LogRatios, (self.seen, self.new, self.order)


def by_word(docs: list[list[str]], m: LogRatios) -> list[np.ndarray]:
    """The ratio of each word of each document, less one."""
    return [np.expm1(np.minimum(np.fromiter(map(m.__getitem__, d), np.float64, len(d)), 500.0)) for d in docs]


def mixed(ratios: list[np.ndarray], share: float) -> np.ndarray:
    return np.array([np.log1p(np.maximum(share * r, -1 + 1e-15)).mean() if len(r) else 0.0 for r in ratios])


def differences(docs: list[list[str]], m: LogRatios, share: float = SHARE) -> np.ndarray:
    """Log-likelihood of each document as a toxic text less that as an ordinary one, by word; 0 without words."""
    return mixed(by_word(docs, m), share)


def auc(x: np.ndarray, y: np.ndarray) -> float:
    """How often a document of label 1 lies above one of label 0, ties a half."""
    values, at, n = np.unique(x, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    k = y.sum()
    return float((rank[y == 1].sum() - k * (k + 1) / 2) / (k * (len(y) - k)))


def logistic(z: np.ndarray, y: np.ndarray, ridge: float = 1e-6) -> tuple[float, float]:
    """Slope and height of the logistic curve over z, both classes counted alike, by damped Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def loss(w: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, (1 - 2 * y) * (x @ w))).sum() + ridge * (w * w).sum() / 2)

    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step, t = np.linalg.solve(hess, x.T @ (weight * (p - y)) + ridge * w), 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
        if t * np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def levelled(x: np.ndarray, model: dict) -> np.ndarray:
    """Differences on a scale on which the many small ones and the few large ones both count."""
    return np.arcsinh((x - model["centre"]) / model["scale"])


def fit(docs: list[tuple[str, int]], order: int = 4, discount: float = 0.75, folds: int = 4) -> dict:
    """The models of all documents; the share of toxic words, and the logistic curve, from what models of the other folds say
    of each fold."""
    if len({y for _, y in docs}) < 2:
        prior = float(docs[0][1]) if docs else 0.0
        return {"a": 0.0, "b": 4.0 if prior else -4.0, "centre": 0.0, "scale": 1.0, "share": SHARE, "m": KneserNey(Counter(), Counter(), order, discount).ratios()}
    sides = [[words(t) for t, y in docs if y == k] for k in (1, 0)]
    parts = [[gram_counts(s[f::folds], order) for f in range(folds)] for s in sides]
    whole = [sum(p, Counter()) for p in parts]
    x, y = [], []
    for f in range(folds):
        # a class of fewer texts than folds keeps them all in each model
        rest = [w - p[f] if len(s) >= folds else w for w, p, s in zip(whole, parts, sides)]
        m = KneserNey(*rest, order, discount).ratios()
        for s, k in zip(sides, (1.0, 0.0)):
            x += by_word(s[f::folds], m)
            y.append(np.full(len(s[f::folds]), k))
    y = np.concatenate(y)
    share = max(SHARES, key=lambda s: (auc(mixed(x, s), y), -s))
    x = mixed(x, share)
    model = {"share": share, "centre": float(np.median(x)), "scale": max(float(np.subtract(*np.quantile(x, (0.75, 0.25)))), 1e-6)}
    a, b = logistic(levelled(x, model), y)
    return model | {"a": a, "b": b, "m": KneserNey(*whole, order, discount).ratios()}


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, held_mod: int = 5, held_rest: int = 0) -> dict:
    """Fit on at most max_docs labelled rows outside the held-out fold, chosen by a hash of the id.

    Half are toxic, or as many as there are; ordinary ones make up the rest.
    """
    lab = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where(f"y in (0, 1) and doc_id is not null").where(crc_mod("doc_id", held_mod) != held_rest).distinct()
    order = (F.xxhash64("doc_id"), "doc_id")
    toxic = cut(lab.where("y = 1").orderBy(*order).limit(max_docs // 2), "toxicity-sample")
    pick = cut(toxic.union(lab.where("y = 0").orderBy(*order).limit(max_docs - toxic.count())), "toxicity-sample")
    # at most max_docs rows: bounded by the two limits above, one text for each id and label
    got = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(pick), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).orderBy(*order, "y", "text").collect()
    return fit([(r.text, r.y) for r in got])


def score_texts(texts: list[str | None], model: dict) -> np.ndarray:
    z = model["a"] * levelled(differences([words(t or "") for t in texts], model["m"], model["share"]), model) + model["b"]
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def score(docs: DataFrame, labels: DataFrame, max_docs: int = 3000, held_mod: int = 5, held_rest: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_docs, held_mod, held_rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score_texts(part.column(1).to_pylist(), model.value))], schema=OUT)

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", held_mod) == held_rest, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_toxicity_kn(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
