"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that count as missing, compared after trimming and lower-casing.
MISSING_TOKENS = ("", "na", "n/a", "nan", "null", "none")
FLOAT = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def clean_cell(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def is_missing(c: Column, tokens: tuple[str, ...] = MISSING_TOKENS) -> Column:
    return F.lower(clean_cell(c)).isin(*tokens)


def finite(c: Column) -> Column:
    """null where c is null, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def to_float(c: Column, dtype: str = "string") -> Column:
    """A cell as a finite double, else null. Text must look like a decimal number."""
    if dtype != "string":
        return finite(c.cast("double"))
    s = strip(c)
    return F.when(s.rlike(FLOAT), finite(F.regexp_replace(s, "_", "").try_cast("double")))


def parse_timestamp(c: Column) -> Column:
    """ISO dates and times, else month/day/year with or without a time; null where none fits."""
    s = strip(c)
    iso = F.when(s.rlike(ISO_DATE), F.regexp_replace(s, r"Z$", "+00:00"))
    zoned = F.when(iso.rlike(r"[+-]\d{2}:?\d{2}$") & s.rlike(r"[T ]"), iso.try_cast("timestamp").cast("timestamp_ntz"))
    # a two-digit hour alone is a full hour
    plain = F.regexp_replace(iso, r"([T ]\d{2})$", "$1:00").try_cast("timestamp_ntz")
    us = [F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy")]
    return F.coalesce(zoned, plain, *us)


def zero_if_odd(c: Column) -> Column:
    """null, NaN and infinities as 0."""
    return F.coalesce(finite(c), F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.least(F.greatest(zero_if_odd(c), F.lit(0.0)), F.lit(1.0))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Where c lies between low and high, from 0 to 1; 0 if they are equal or anything is not finite."""
    ratio = (c - low) / F.when(high > low, high - low)
    return clamp(ratio)


def weighted(pairs: list[tuple[float, Column]]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * c for w, c in pairs]) / F.lit(float(sum(w for w, _ in pairs)))


def similarity(distance: Column, metric: str) -> Column:
    if metric == "euclidean":
        return 1 / (1 + F.greatest(distance, F.lit(0.0)))
    return F.least(F.greatest(1 - distance, F.lit(-1.0)), F.lit(1.0))


def change_id(sequence: Column, strategy: Column, source: Column, target: Column) -> Column:
    nul = F.lit("\x00")
    parts = F.concat(sequence.cast("string"), nul, strategy, nul, source.cast("string"), nul, target.cast("string"))
    return F.concat(F.lit("change-"), F.substring(F.sha2(parts, 256), 1, 16))


def relative_path(c: Column) -> Column:
    """A portable relative path; raises for absolute paths, drives and parent steps."""
    s = F.regexp_replace(c, r"\\", "/")
    bad = s.startswith("/") | s.rlike(r"^[A-Za-z]:") | s.rlike(r"(^|/)\.\.(/|$)") | (s == "")
    return F.when(bad, F.raise_error(F.concat(F.lit("not a relative path: "), c))).otherwise(F.regexp_replace(F.regexp_replace(s, r"(^|/)(\./)+", "$1"), r"/+", "/"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
