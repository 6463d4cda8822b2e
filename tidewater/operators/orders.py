"""Running sums and row numbers over a whole table without a task that holds its order."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranges(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One row: `_e`, at most n - 1 edges of roughly even ranges of a numeric key, and `_c`, every isqrt(n)-th of them.

    The edges depend on the order in which tasks end, so they are found once; a plan that uses them twice must not get two.
    """
    step = isqrt(n)
    edges = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("_e"))
    edges = rows.sparkSession.createDataFrame(edges.toArrow(), edges.schema)
    return edges.select("_e", F.filter("_e", lambda x, i: (i + 1) % step == 0).alias("_c"))


def range_of(key: str, n: int) -> Column:
    """How many edges of ranges() lie below the key: a look at the coarse ones, then at one stretch of the others."""
    below = lambda e: F.coalesce(F.size(F.filter(e, lambda x: x < F.col(key))), F.lit(0))
    start = below(F.col("_c")) * isqrt(n)
    return start + below(F.slice("_e", start + 1, F.lit(isqrt(n))))


def running(rows: DataFrame, key: str, columns: list[str], descending: bool = False, buckets: int | None = None) -> DataFrame:
    """rows, unique by a numeric key, with `<c>_before` (the sum of column c over all keys before) and `<c>_total`.

    Keys are cut into ranges by approximate quantiles, which only have to be roughly even. A window sums inside each
    range, another one over a row for each range; the latter is as small as the number of ranges.
    """
    n = buckets or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.crossJoin(F.broadcast(ranges(rows, key, n))).withColumn("_b", range_of(key, n)).drop("_e", "_c")
    down = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_b").agg(*[F.sum(c).alias(f"_s{i}") for i, c in enumerate(columns)])
    over = Window.orderBy(down("_b"))
    sums = sums.select("_b", *[x for i in range(len(columns)) for x in (F.coalesce(F.sum(f"_s{i}").over(past(over)), F.lit(0)).alias(f"_p{i}"), F.sum(f"_s{i}").over(Window.partitionBy()).alias(f"_t{i}"))])
    inside = Window.partitionBy("_b").orderBy(down(key))
    out = ranged.select("*", *[F.coalesce(F.sum(c).over(past(inside)), F.lit(0)).alias(f"_i{i}") for i, c in enumerate(columns)]).join(F.broadcast(sums), "_b")
    added = [x for i, c in enumerate(columns) for x in ((F.col(f"_p{i}") + F.col(f"_i{i}")).alias(f"{c}_before"), F.col(f"_t{i}").alias(f"{c}_total"))]
    return out.select(*rows.columns, *added)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """rows, unique by a numeric key, with their number from 1 in its order."""
    one = running(rows.withColumn("_one", F.lit(1).cast("long")), key, ["_one"])
    return one.withColumn(name, (F.col("_one_before") + 1).cast("int")).drop("_one", "_one_before", "_one_total")


def order_statistics(rows: DataFrame, value: str, places: dict[str, Callable[[Column], Column]], weight: str | None = None) -> dict[str, float | None]:
    """The value at each named place of a column's order, exactly; None without values.

    A place is a function of the number of values and counts from 0; between two places it takes the line between their
    values. Null values are left out, `weight` says how often a row counts. Equal values are counted before they are
    ordered, by ranges. One action, as a few numbers are all that comes back.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(n.alias("_n")).persist()  # ranges, sums and places read them

    def held(at: Column) -> Column:
        return F.max(F.when((F.col("_n_before") <= at) & (at < F.col("_n_before") + F.col("_n")), F.col("_v")))

    found = []
    for name, place in places.items():
        at = place(F.col("_n_total"))
        low = held(F.floor(at))
        found.append((low + (held(F.ceil(at)) - low) * F.max(at - F.floor(at))).alias(name))
    row = running(counts, "_v", ["_n"]).agg(*found).first()
    counts.unpersist()
    return row.asDict()


def medians(rows: DataFrame, group: str, value: str, ranges: int = 64) -> DataFrame:
    """group, median (of even numbers the mean of the middle two), exactly, without a map of a group's values in a task.

    Values are counted by ranges of their group; only the ranges that hold the middle are ordered.
    """
    edges = rows.groupBy(group).agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_e"))
    ranged = rows.select(group, value).join(edges, group).select(group, value, F.size(F.filter("_e", lambda x: x < F.col(value))).alias("_b"))
    by = Window.partitionBy(group)
    counts = ranged.groupBy(group, "_b").agg(F.count("*").alias("_n"))
    counts = counts.select(group, "_b", "_n", F.coalesce(F.sum("_n").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_p"), F.sum("_n").over(by).alias("_t"))
    low, high = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    middle = counts.where((F.col("_p") <= high) & (F.col("_p") + F.col("_n") > low))
    ranked = ranged.join(middle, [group, "_b"]).withColumn("_r", F.col("_p") + F.row_number().over(Window.partitionBy(group, "_b").orderBy(value)) - 1)
    return ranked.where((F.col("_r") == low) | (F.col("_r") == high)).groupBy(group).agg(F.avg(value).alias("median"))
