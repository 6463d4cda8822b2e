"""Quality rules whose cutoffs come with a bound on the good documents they reject.

Rules are shares of a document that are high in bad ones: symbols, capitals, repeated lines, repeated words, and long
words, each a whole number from 0 to 1000. The labelled documents of a stratum (a language) are dealt to two folds by a
hash of their ids. On the first, each rule gets the cutoff that separates bad from good best, and the rules are put in
order of what they gain. The second is the holdout: the first rule is tested there, then the first two together, and so
on. A set of rules holds if so few good documents of the holdout fail any of them that, were `most` or more of all good
ones to fail, so few or fewer would be seen with a chance of at most delta divided by the number of strata: the exact
binomial tail. The sets are nested and tested in a fixed order that ends at the first that does not hold, so within a
stratum no further correction is due; the strata are corrected for by Bonferroni. With probability 1 - delta, in no
stratum do the chosen rules reject more than `most` of the good documents that pass the base filter.

Edge cases: a null text has no words; a null lang is a stratum of its own under the empty name. Documents without an id,
with labels that contradict each other, or that the base filter rejects, are not learned from. A stratum with too few
labels gets no rule, so nothing but the base filter rejects there; so does one whose labels are all alike. Rows count
one by one, extra columns are ignored, and empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, cut

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
#: Bytes that continue a character in UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_capitals"]
#: rule: what is divided by what, times what, rounded down.
RULES = {
    "symbols": ("n_symbols", "word_chars", 1000),
    "capitals": ("n_capitals", "word_chars", 1000),
    "repeated_lines": ("n_dup_lines", "n_lines", 1000),
    "repeated_words": ("n_repeat_words", "n_words", 1000),
    "long_words": ("word_chars", "n_words", 20),
}
TOP = 1000
OUT = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *[(c, pa.int64()) for c in COUNTS]])


def repeated(words: list[bytes], k: int = 3) -> int:
    """How many words lie in a window of k words that the text holds twice or more."""
    if len(words) <= k:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    at = w[: len(w) - k + 1]
    for j in range(1, k):  # numbers of the runs so far, so that nothing overflows
        _, at = np.unique(at * len(ids) + w[j : len(w) - k + 1 + j], return_inverse=True)
    often = np.bincount(at)[at] > 1
    inside = np.zeros(len(w), bool)
    for j in range(k):
        inside[j : j + len(often)] |= often
    return int(inside.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The numbers in COUNTS of one text in UTF-8. Only spaces, tabs and line ends of ASCII part words."""
    words, seen, again = text.split(), set(), 0
    lines = [x for x in text.split(b"\n") if x.translate(None, SPACE)]
    for x in lines:
        again += x in seen
        seen.add(x)
    less = lambda s: len(text) - len(text.translate(None, s))
    return len(words), len(text.translate(None, SPACE + CONTINUED)), less(SYMBOLS), again, repeated(words), len(lines), less(CAPITALS)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and COUNTS of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                got = np.array([counts(t.as_py()) for t in part.column(2)], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, got.T)], schema=OUT)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    return slim.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def values() -> Column:
    """The rules' whole numbers in order, 0 where there is nothing to divide by."""
    each = (F.try_divide(F.col(over) * times, F.col(under)) for over, under, times in RULES.values())
    return F.array(*[F.least(F.coalesce(F.floor(x), F.lit(0)), F.lit(TOP)).cast("int") for x in each])


def tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), each with chance p: the exact binomial tail, summed down from k."""
    if k >= n:
        return 1.0
    if not 0 < p < 1:
        return 1.0 if p <= 0 else 0.0
    total = 0.0
    for i in range(k, -1, -1):
        term = exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p))
        total += term
        if i < n * p and term <= total * 1e-17:  # below the mean the terms only shrink
            break
    return min(total, 1.0)


def holds(k: int, n: int, most: float, delta: float) -> bool:
    """Whether k failures among n tell with confidence 1 - delta that fewer than `most` of all fail."""
    return n > 0 and tail(k, n, most) <= delta


def proposals(rows: DataFrame, weight: int = 4) -> DataFrame:
    """stratum and its rules as an array of (rank, i, cutoff): rows hold stratum, v (values) and good (0 or 1).

    A rule rejects what lies above its cutoff, and gains the share of the bad documents rejected less `weight` times that
    of the good; among cutoffs that reject the same the middle one is taken, among equal gains the highest, and rules that
    gain nothing are left out. Documents are counted
    by value before anything is ordered, so a stratum has at most 1,001 rows a rule.
    """
    seen = rows.select("stratum", "good", F.posexplode("v").alias("i", "x")).groupBy("stratum", "i", "x").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    whole = Window.partitionBy("stratum", "i")
    above = whole.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    n = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("decimal(38,0)")
    # cutoffs from a value up to below the next that there is reject the same: the middle stays away from both
    up = F.coalesce(F.lag("x").over(whole.orderBy(F.desc("x"))) - 1, F.lit(TOP))
    gain = n("b", above) * n("g", whole) - n("g", above) * n("b", whole) * weight
    at = seen.select("stratum", "i", F.floor((F.col("x") + up) / 2).cast("int").alias("cutoff"), gain.alias("gain"), (n("g", whole) * n("b", whole)).alias("both")).where("gain > 0 and both > 0")
    best = at.groupBy("stratum", "i").agg(F.max(F.struct("gain", "cutoff")).alias("m"))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("m.gain"), "i"))
    return best.select("stratum", rank.alias("rank"), "i", "m.cutoff").groupBy("stratum").agg(F.array_sort(F.collect_list(F.struct("rank", "i", "cutoff"))).alias("rules"))


def first_failed(rules: str = "rules") -> Column:
    """The rank of the first rule that v fails, or a number past all of them."""
    past = len(RULES) + 1
    ranks = F.transform(rules, lambda r: F.when(F.get("v", r["i"]) > r["cutoff"], r["rank"]).otherwise(past))
    return F.coalesce(F.array_min(ranks), F.lit(past))


def certified(rows: DataFrame, proposed: DataFrame, most: float, delta: float) -> DataFrame:
    """proposed with `held`, how many of its rules hold on the holdout's rows, and the good ones' counts (n, failures)."""
    strata = proposed.agg(F.count(F.lit(1)).alias("strata"))  # one row
    ranks = range(1, len(RULES) + 1)
    told = rows.where("good = 1").join(proposed, "stratum").select("stratum", first_failed().alias("f"))
    seen = told.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("f") <= j) for j in ranks]).alias("failures"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            held = []
            for r in p.itertuples():
                j = 0
                while j < r.size and holds(r.failures[j], r.n, most, delta / r.strata):
                    j += 1
                held.append(j)
            yield p[["stratum", "n", "failures"]].assign(held=held)

    counted = seen.join(proposed.select("stratum", F.size("rules").alias("size")), "stratum").crossJoin(F.broadcast(strata))
    judged = counted.mapInPandas(run, "stratum string, n long, failures array<long>, held int")
    return proposed.join(judged, "stratum")


def cutoffs(measured_rows: DataFrame, labels: DataFrame, most: float = 0.05, delta: float = 0.05, weight: int = 4) -> DataFrame:
    """stratum, rules (rank, i, cutoff), n, failures, held of the strata that have a rule to propose.

    Ids whose crc32 as text leaves 0 by 3 propose, the others are the holdout.
    """
    good = F.col("quality").cast("int")
    told = labels.where(good.isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("good"), F.max(good).alias("other")).where("good = other").drop("other")
    rows = measured_rows.where(~base_failed()).select("doc_id", "stratum", values().alias("v")).join(told, "doc_id")
    rows = cut(rows, "labelled-values")
    proposing = crc_mod("doc_id", 3) == 0
    proposed = cut(proposals(rows.where(proposing), weight), "proposed-rules")
    return certified(rows.where(~proposing), proposed, most, delta)


def judge(docs: DataFrame, labels: DataFrame, most: float = 0.05, delta: float = 0.05, weight: int = 4) -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed, failed_rule (the name of the first chosen rule that is failed, or null) and
    kept of every row of docs. At most `most` of a stratum's good documents that pass the base fail a rule, with
    confidence 1 - delta for all strata together."""
    rows = cut(measured(docs), "measured")
    chosen = cutoffs(rows, labels, most, delta, weight).where("held > 0").select("stratum", F.slice("rules", 1, F.col("held")).alias("rules"))
    out = rows.withColumn("v", values()).join(chosen, "stratum", "left").withColumn("f", first_failed())
    names = F.array(*map(F.lit, RULES))
    failed = F.when(F.col("f") <= len(RULES), F.get(names, F.get("rules", F.col("f") - 1)["i"]))
    return out.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), failed.alias("failed_rule"), (~base_failed() & failed.isNull()).alias("kept"))


def op12_risk_controlled_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


#: The same from the contract's words: window functions for repeats, the binomial tail as a sum, crc32 bit by bit.
OP12_SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS li FROM d),
tri AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT row, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT row, count(DISTINCT i + j) AS n FROM tri, range(0, 3) r(j) WHERE c > 1 GROUP BY row),
m AS (SELECT doc_id, stratum, len(w)::bigint AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols,
 (len(li) - len(list_distinct(li)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, len(li) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_capitals FROM w LEFT JOIN rep USING (row)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_transform([n_symbols * 1000 // word_chars, n_capitals * 1000 // word_chars, n_dup_lines * 1000 // n_lines, n_repeat_words * 1000 // n_words, word_chars * 20 // n_words], lambda x: least(coalesce(x, 0), 1000)) AS v FROM m),
lab AS (SELECT doc_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
lr AS (SELECT v.*, good, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, (c & 1) * 3988292384))), 4294967295) % 3 = 0 AS proposing FROM v JOIN lab USING (doc_id) WHERE NOT base_failed),
h AS (SELECT stratum, i, v[i] AS x, sum(good) AS g, sum(1 - good) AS b FROM lr, range(1, 6) r(i) WHERE proposing GROUP BY ALL),
c AS (SELECT stratum, i, cc AS cutoff, (SELECT coalesce(sum(b), 0) FROM h k WHERE k.stratum = a.stratum AND k.i = a.i AND k.x > cc) * g - 4 * b * (SELECT coalesce(sum(g), 0) FROM h k WHERE k.stratum = a.stratum AND k.i = a.i AND k.x > cc) AS gain
 FROM (SELECT stratum, i, sum(g) AS g, sum(b) AS b FROM h GROUP BY ALL) a, range(0, 1001) r(cc)),
hi AS (SELECT stratum, i, max(gain) AS gain, arg_max(cutoff, gain * 10000 + cutoff) AS hi FROM c WHERE gain > 0 GROUP BY ALL),
pr AS (SELECT stratum, i, gain, (hi + (SELECT max(x) FROM h WHERE h.stratum = hi.stratum AND h.i = hi.i AND x <= hi)) // 2 AS cutoff, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, i) AS rank FROM hi),
ho AS (SELECT stratum, n, sum((f <= rank)::int) AS k, pr.rank FROM (SELECT lr.stratum, (SELECT min(rank) FROM pr WHERE pr.stratum = lr.stratum AND lr.v[pr.i] > pr.cutoff) AS f, count(*) OVER (PARTITION BY lr.stratum) AS n FROM lr WHERE NOT proposing AND good = 1) JOIN pr USING (stratum) GROUP BY stratum, n, pr.rank),
te AS (SELECT stratum, rank, list_sum(list_transform(range(0, coalesce(k, 0)::int + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n - i + 1) + i * ln(0.05) + (n - i) * ln(0.95)))) <= 0.05 / (SELECT count(DISTINCT stratum) FROM pr) AS ok FROM ho),
fin AS (SELECT pr.* FROM pr JOIN te USING (stratum, rank) WHERE NOT EXISTS (SELECT 1 FROM te z WHERE z.stratum = pr.stratum AND z.rank <= pr.rank AND NOT z.ok))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM fin WHERE fin.stratum = v.stratum AND v.v[fin.i] > fin.cutoff) AS kept FROM v"""
