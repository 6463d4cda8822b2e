"""Mixing sources to target weights by temperature, with DataFrame functions alone.

A source's weight is its share of all tokens to the power `a`, normalised. `a` = 1 keeps the shares, 0 makes the sources
equal. The exponent is bisected: the smallest at which no source is repeated more than `repetition_limit` times, or the
largest at which the entropy of the weights reaches `target_entropy` (in nats). A source's budget is its weight of the
total budget. It is spent on whole epochs, and in the last epoch on a prefix of a permutation: documents lie in blocks by
a hash, each epoch orders the blocks by a hash of its own and the documents in a block likewise, and the prefix ends
where the budget does. Running sums go over the blocks of a source and over the documents of one block, never over a
source's documents in one task.

Edge cases: a null source is a source of its own; a null or empty text has no tokens, costs nothing and is taken once;
rows that share doc_id and source are one document and stay together; a null doc_id is an id of its own; an empty table
gives an empty result; extra columns are kept by mix() and ignored by plan().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK_DOCS = 1024


def order_key(*parts: Column | str) -> Column:
    """A hash that orders rows at random, the same in any SQL engine: the hex MD5 of the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts]))


def hash_int(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, repetition_limit: float | None, target_entropy: float | None, relative: bool = False, steps: int = 45) -> float:
    """Bisect the exponent on (tokens) rows of the sources. Each pass asks for 15 exponents, four halvings, at once.

    relative: the limit holds for repetitions as multiples of those of the largest source, which is repeated least.
    """
    sources = sources.where("tokens > 0")
    total, least, most, n = sources.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count("*")).first()
    if not n or n == 1:
        return 1.0
    logs = sources.select(F.log(F.col("tokens") / F.lit(float(total))).alias("x"))
    smallest = math.log(least / total)

    def good(a: float, z: float, zx: float) -> bool:
        if relative and repetition_limit is not None:
            return (1 - a) * math.log(most / least) <= math.log(repetition_limit)
        if repetition_limit is not None:
            return (a - 1) * smallest - math.log(z) <= math.log(repetition_limit)
        return math.log(z) - a * zx / z >= target_entropy

    lo, hi = 0.0, 1.0  # for a limit: hi holds, lo may not; for an entropy: lo may hold, hi may not
    done = 0
    while done < steps:
        k = min(4, steps - done)
        grid = [lo + (hi - lo) * i / 2**k for i in range(2**k + 1)]
        row = logs.agg(*[F.sum(F.exp(F.lit(a) * F.col("x"))) for a in grid], *[F.sum(F.exp(F.lit(a) * F.col("x")) * F.col("x")) for a in grid]).first()
        ok = [good(a, row[i], row[len(grid) + i]) for i, a in enumerate(grid)]
        left, right = 0, 2**k
        if done == 0:
            if repetition_limit is not None and ok[0]:
                return 0.0
            if repetition_limit is None and ok[-1]:
                return 1.0
            if repetition_limit is None and not ok[0]:
                return 0.0
        for _ in range(k):
            mid = (left + right) // 2
            if ok[mid] == (repetition_limit is not None):
                right = mid
            else:
                left = mid
        lo, hi = grid[left], grid[right]
        done += k
    return hi if repetition_limit is not None else lo


def plan(docs: DataFrame, repetition_limit: float | None = 2.0, target_entropy: float | None = None, budget_tokens: int | None = None, keep_all: bool = False, block_docs: int = BLOCK_DOCS, seed: str = "mix") -> DataFrame:
    """doc_id, source, n_tokens, epoch, block_rank, position: a row for each time that a document is taken.

    budget_tokens is the whole budget (None: all tokens). keep_all raises it until every source is taken whole at least
    once; then no document is left out, the weights still hold, and the limit counts from there.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), token_count(F.col("text").cast("string")).alias("n"))
    base = cut(rows.groupBy("doc_id", "source").agg(F.sum("n").alias("n_tokens")), "mix-base")
    sources = cut(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-sources")
    a = exponent(sources, repetition_limit, target_entropy, relative=keep_all)
    live = sources.where("tokens > 0")
    total = live.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    share = F.col("tokens") / F.lit(float(total or 1))
    power = F.exp(F.lit(a) * F.log(share))
    z, most = live.agg(F.coalesce(F.sum(power), F.lit(1.0)), F.coalesce(F.max(F.col("tokens") / power), F.lit(0.0))).first()
    budget = float(total if budget_tokens is None else budget_tokens)
    if keep_all:
        budget = max(budget, most * z)
    wanted = F.round(F.lit(budget) * power / F.lit(z), 3)
    budgets = sources.select("source", "tokens", F.ceil(F.col("docs") / F.lit(block_docs)).cast("long").alias("blocks"), F.when(F.col("tokens") > 0, F.floor(wanted)).otherwise(0).alias("budget"))
    budgets = budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    rows = base.alias("b").join(budgets.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.*", "blocks", "epochs", "rest")
    rows = rows.withColumn("block", F.pmod(hash_int(order_key(seed, F.col("doc_id"))), F.col("blocks")))
    last = F.when(F.col("n_tokens") > 0, F.col("epochs")).otherwise(0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    key = ["source", "epoch", "block"]
    # running sums over blocks: a row for each source, epoch and block
    blocks = rows.groupBy(*key).agg(F.sum("n_tokens").alias("t"))
    by_block = Window.partitionBy("source", "epoch").orderBy(order_key(seed, F.col("source"), F.col("epoch"), F.col("block")), "block")
    blocks = blocks.select(*key, F.row_number().over(by_block).cast("long").alias("block_rank"), F.coalesce(F.sum("t").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    in_block = Window.partitionBy("source", "block", "epoch").orderBy(order_key(seed, F.col("epoch"), F.col("doc_id")), F.col("doc_id").asc_nulls_first())
    placed = rows.select("*", F.row_number().over(in_block).cast("long").alias("position"), F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    placed = placed.alias("p").join(blocks.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.block") == F.col("k.block")) & (F.col("p.epoch") == F.col("k.epoch")))
    taken = placed.where("p.n_tokens = 0 or p.epoch < p.epochs or k.before + p.upto <= p.rest")
    return taken.select("p.doc_id", "p.source", "p.n_tokens", F.col("p.epoch").cast("int").alias("epoch"), "k.block_rank", "p.position")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as plan() takes it, with the columns of docs."""
    times = plan(docs, **options).groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("_times"))
    d, t = docs.alias("d"), times.alias("t")
    both = d.join(t, F.col("d.doc_id").cast("long").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").cast("string").eqNullSafe(F.col("t.source")))
    # inside a struct the columns of docs may have any names
    return both.select(F.struct("d.*").alias("row"), F.explode(F.sequence(F.lit(1), F.col("t._times"))).alias("nth")).select("row.*")


def op10_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(spark.read.parquet(f"{sf_dir}/documents.parquet"), repetition_limit=2.0)


OP10_SQL = r"""
WITH RECURSIVE base AS (SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::bigint AS n_tokens FROM documents GROUP BY doc_id, source),
sources AS (SELECT source, sum(n_tokens)::bigint AS tokens, count(*) AS docs FROM base GROUP BY source),
x AS (SELECT ln(tokens / (SELECT sum(tokens) FROM sources)::double) AS x FROM sources WHERE tokens > 0),
low AS (SELECT min(x) AS x FROM x),
ok0 AS (SELECT -low.x - ln((SELECT count(*) FROM x)) <= ln(2.0::double) AS ok FROM low),
bisect(step, lo, hi) AS (
  SELECT 0, 0.0::double, 1.0::double
  UNION ALL
  SELECT step + 1, CASE WHEN ok THEN lo ELSE (lo + hi) / 2 END, CASE WHEN ok THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT step, lo, hi, ((lo + hi) / 2 - 1) * (SELECT x FROM low) - ln((SELECT sum(exp((lo + hi) / 2 * x.x)) FROM x)) <= ln(2.0::double) AS ok FROM bisect WHERE step < 45)),
a AS (SELECT CASE WHEN (SELECT ok FROM ok0) THEN 0.0 ELSE hi END AS a FROM bisect WHERE step = 45),
tot AS (SELECT sum(tokens)::double AS t FROM sources),
z AS (SELECT sum(exp(a.a * x.x)) AS z FROM x, a),
budgets AS (SELECT source, tokens, ceil(docs / 1024.0)::bigint AS blocks,
   CASE WHEN tokens > 0 THEN floor(round(tot.t * exp(a.a * ln(tokens / tot.t)) / z.z, 3))::bigint ELSE 0 END AS budget FROM sources, tot, a, z),
b2 AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM budgets),
r0 AS (SELECT base.*, blocks, epochs, budget - epochs * tokens AS rest, ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, '')), 1, 8))::bigint % blocks AS block
   FROM base JOIN b2 ON base.source IS NOT DISTINCT FROM b2.source),
r AS (SELECT r0.*, unnest(range(0, CASE WHEN n_tokens > 0 THEN epochs ELSE 0 END + 1)) AS epoch FROM r0),
blk AS (SELECT source, epoch, block, sum(n_tokens) AS t FROM r GROUP BY source, epoch, block),
blk2 AS (SELECT source, epoch, block, row_number() OVER w AS block_rank, coalesce(sum(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM blk WINDOW w AS (PARTITION BY source, epoch ORDER BY md5('mix|' || coalesce(source, '') || '|' || epoch || '|' || block), block)),
p AS (SELECT r.*, row_number() OVER w AS position, sum(n_tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
   FROM r WINDOW w AS (PARTITION BY source, block, epoch ORDER BY md5('mix|' || epoch || '|' || coalesce(doc_id::varchar, '')), doc_id))
SELECT p.doc_id, p.source, p.n_tokens, p.epoch::int AS epoch, block_rank, position
FROM p JOIN blk2 k ON p.source IS NOT DISTINCT FROM k.source AND p.block = k.block AND p.epoch = k.epoch
WHERE p.n_tokens = 0 OR p.epoch < p.epochs OR k.before + p.upto <= p.rest
"""
