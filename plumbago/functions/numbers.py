"""Numbers out of text, arrays of fixed length, vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing metric, signs between a value and its delta, and multipliers by suffix, in order.
MISSING = ["-", "--", "–", "?", "", "%"]
DELTA_SIGNS = ["+/-", "±", "+-", "-+"]
SUFFIXES = [("M", 1e6), ("m", 1e6), ("M+", 1e6), ("m+", 1e6), ("MB", 1e6), ("K", 1e3), ("k", 1e3), ("B", 1e9), ("G", 1e9)]


def lenient(x: Column) -> Column:
    """A number with commas dropped and all digits after the first dot joined; null if it is none."""
    t = F.replace(F.trim(x), F.lit(","), F.lit(""))
    whole, rest = F.split_part(t, F.lit("."), F.lit(1)), F.regexp_replace(t, r"^[^.]*\.?", "")
    return F.concat(whole, F.lit("."), F.replace(rest, F.lit("."), F.lit(""))).try_cast("double")


def value_and_delta(x: Column, symbol: str = "±") -> Column:
    """(value, delta) of a text with one such symbol, `%` ignored; nulls otherwise."""
    parts = F.split(F.replace(x, F.lit("%"), F.lit("")), re.escape(symbol))
    of = lambda i: F.when(F.size(parts) == 2, lenient(F.get(parts, F.lit(i))))
    return F.struct(of(0).alias("value"), of(1).alias("delta"))


def metric(x: Column) -> Column:
    """A metric's number: missing markers, brackets, `%`, decimal commas, deltas (left out) and suffixes allowed for; null if it is none."""
    t = x
    for end in "-–e":
        t = F.btrim(t, F.lit(end))
    missing = t.isin(MISSING)
    t = F.when(t.contains(",") & ~t.rlike("[().]"), F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    t = F.split_part(t, F.lit("("), F.lit(1))

    def number(v: Column) -> Column:
        v = F.replace(F.replace(v, F.lit("%"), F.lit("")), F.lit(".."), F.lit("."))
        return lenient(F.replace(v, F.lit(":"), F.lit(".")))

    out = number(t)
    for suffix, times in reversed(SUFFIXES):
        out = F.when(t.endswith(suffix), number(F.substr(t, F.lit(1), F.length(t) - len(suffix))) * times).otherwise(out)
    for sign in reversed(DELTA_SIGNS):
        out = F.when(t.contains(sign), value_and_delta(t, sign)["value"]).otherwise(out)
    return F.when(~missing, out)


def metric_values(x: Column) -> Column:
    """Numbers of a metric with several: split at `/` and `|`; `a x b` is a product."""
    def one(p: Column) -> Column:
        factors = F.transform(F.split(p, " x "), metric)
        return F.aggregate(factors, F.lit(1.0), lambda a, b: a * b)

    return F.transform(F.split(x, "[/|]"), lambda p: one(F.trim(p)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def padded(a: Column, n: int, pad: Column) -> Column:
    """Exactly n elements: cut, or filled up at the end."""
    return F.slice(F.concat(a, F.array_repeat(pad, n)), 1, n)
