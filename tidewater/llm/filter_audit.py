"""What five filters lose, alone and together, in every order: inclusion and exclusion over joint failures.

For every set of filters the documents that fail all of it are counted, as the sum of the product of their flags. Those
32 counts of a part determine everything else: what is left after a set of filters is an alternating sum over its
subsets, the documents that fail one filter only are the Moebius inverse at that filter, and a filter's Shapley value is
its share of the Harsanyi dividends, the signed joint counts. So no order is ever applied to the documents themselves.

Edge cases: a null text counts as empty, and so does a null lang. Equal texts under one doc_id are not each other's
earlier copies; a row without doc_id has no smaller or larger one and no label, so it never fails as a copy. A label
counts if any row of labels says so. Rows of documents count one by one, extra columns are ignored, and an empty table
has no parts and no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
SPACE = " \t\n\x0b\x0c\r"
WEIGHTS = ("n", "good", "toxic")


def flagged(docs: DataFrame) -> DataFrame:
    """doc_id, part, the text's SHA-256 and which of the filters A to D it fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = F.trim(F.col("t"), F.lit(SPACE))
    words = F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", r"[\x20\x09-\x0D]+"))
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    # capitals are single bytes, so bytes may be counted in place of characters
    capitals = F.octet_length("t") - F.octet_length(F.regexp_replace("t", "[A-Z]+", ""))
    split = plain.withColumn("inner", inner).withColumn("w", words)
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    return split.select(
        "doc_id",
        "part",
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        (n < 100).alias("A"),
        (100 * distinct < 80 * n).alias("B"),
        (100 * capitals > 10 * F.char_length("t")).alias("C"),
        F.col("t").rlike(r"[#$%&*|]").alias("D"),
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the five flags, good and toxic of every row of docs.

    The rows without texts are written once. The first document of each text is found by an aggregation, which combines
    before it shuffles; documents then look for themselves among the first ones by id and text, so a text that very many
    share is no hot key.
    """
    slim = cut(flagged(docs), "filter-flags")
    first = slim.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = slim.join(first, ["doc_id", "digest"], "left").withColumn("E", F.col("doc_id").isNotNull() & F.col("first").isNull())
    marks = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return rows.select("doc_id", "part", *FILTERS).join(told, "doc_id", "left").select("part", *FILTERS, F.lit(1).alias("n"), *marks)


def joint_failures(rows: DataFrame, weights: tuple[str, ...] = WEIGHTS) -> DataFrame:
    """part and, for each weight, an array: at place s the weight of the rows that fail every filter of the set s."""
    flags = rows.select("part", *[F.col(c).cast("long").alias(c) for c in (*FILTERS, *weights)])
    product = lambda w, s: " * ".join([w, *(f for i, f in enumerate(FILTERS) if s >> i & 1)])
    sums = flags.groupBy("part").agg(*[F.expr(f"sum({product(w, s)})").alias(f"{w}_{s}") for w in weights for s in range(ALL + 1)])
    return sums.select("part", *[F.array(*[f"{w}_{s}" for s in range(ALL + 1)]).alias(w) for w in weights])


def alternating(joint: str, which: str, times: str = "1", odd: bool = False) -> str:
    """SQL for the sum of the joint counts of the sets u for which `which` holds, each `times` over, signed by the number
    of their filters; with `odd` sets of an odd number count as they are, the others negated."""
    sign = f"CASE WHEN bit_count(u) % 2 = {int(odd)} THEN 1 ELSE -1 END"
    return f"aggregate(sequence(0, {ALL}), 0L, (a, u) -> a + CASE WHEN {which} THEN {sign} * {times} * {joint}[u] ELSE 0L END)"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    600 rows a part: five steps of each of the 120 orders of the filters.
    """
    joint = joint_failures(judged(docs, labels))
    orders = ["".join(p) for p in permutations(FILTERS)]
    each_filter, has = f"sequence(0, {len(FILTERS) - 1})", "(shiftright(u, i) & 1) = 1"
    # left after each set of filters, by inclusion and exclusion over its subsets
    left = [F.expr(f"transform(sequence(0, {ALL}), s -> {alternating(w, '(u & s) = u')})").alias(f"left_{w}") for w in WEIGHTS]
    # the Moebius inverse at a single filter: fail it and no other
    alone = F.expr(f"transform({each_filter}, i -> {alternating('n', has, odd=True)})").alias("alone")
    # a dividend of a set, (-1)^(size + 1) times its joint failures, is shared equally; 120 orders make the shares whole
    shares = F.expr(f"transform({each_filter}, i -> {alternating('n', has, f'({len(orders)} div bit_count(u))', odd=True)})").alias("shares")
    fails = F.expr(f"transform({each_filter}, i -> n[shiftleft(1, i)])").alias("fails")
    parts = joint.select("part", *left, alone, shares, fails)
    each = parts.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(orders)), " "))).withColumn("step", F.explode(F.expr(f"sequence(1, {len(FILTERS)})")))
    place = F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")) - 1
    before = sum((F.when(F.locate(f, F.expr("substring(filter_order, 1, step - 1)")) > 0, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))
    at = each.withColumn("i", place).withColumn("before", before).withColumn("after", F.col("before") + F.expr("shiftleft(1, i)"))
    lost = lambda w: F.col(f"left_{w}")[F.col("before")] - F.col(f"left_{w}")[F.col("after")]
    return at.select(
        "part",
        "filter_order",
        "step",
        F.col("left_n")[F.col("after")].alias("kept"),
        lost("n").alias("removed"),
        (F.col("fails")[F.col("i")] - lost("n")).alias("redundant"),
        F.col("alone")[F.col("i")].alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.col("shares")[F.col("i")].alias("shapley"),
    )


def op11_filter_interaction(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


#: Every order is applied to every combination of flags, filter by filter.
OP11_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)::int) AS good, max(coalesce(toxic = 1, false)::int) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS C,
 regexp_matches(t, '[#$%&*|]') AS D, coalesce(w.doc_id > first, false) AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l USING (doc_id)),
p AS (SELECT part, [A, B, C, D, E] AS fl, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::int AS step, substr(filter_order, step::int, 1) AS letter, ascii(substr(filter_order, step::int, 1)) - 64 AS i, list_transform(range(1, step::int), lambda k: ascii(substr(filter_order, k::int, 1)) - 64) AS earlier FROM o, range(1, 6) r(step)),
j AS (SELECT part, filter_order, step, letter, fl[i] AS fails, len(list_filter(earlier, lambda k: fl[k])) > 0 AS gone, len(list_filter(fl, lambda b: b)) = 1 AS only_one, n, good, toxic FROM p, s),
g AS (SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE NOT fails AND NOT gone) AS kept, sum(n) FILTER (WHERE fails AND NOT gone) AS removed, sum(n) FILTER (WHERE fails AND gone) AS redundant,
 sum(n) FILTER (WHERE fails AND only_one) AS unique_fails, sum(good) FILTER (WHERE fails AND NOT gone) AS good_lost, sum(toxic) FILTER (WHERE fails AND NOT gone) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::bigint AS kept, coalesce(removed, 0)::bigint AS removed, coalesce(redundant, 0)::bigint AS redundant, coalesce(unique_fails, 0)::bigint AS unique_fails,
 coalesce(good_lost, 0)::bigint AS good_lost, coalesce(toxic_lost, 0)::bigint AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::bigint AS shapley FROM g"""
