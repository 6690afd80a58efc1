"""Strings, sequences, vectors and guarded arithmetic as columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTUNacgtun", "TGCAANtgcaan"))


def gc_content(c: Column) -> Column:
    """Share of G and C among A, C, G and T; null without any."""
    n = F.length(F.regexp_replace(c, "[^ACGTacgt]", ""))
    return F.try_divide(F.length(F.regexp_replace(c, "[^GCgc]", "")), n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def pretty_int(c: Column) -> Column:
    return F.format_number(c, 0)


def int_of_pretty(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).cast("long")


def guess_type(c: Column) -> Column:
    """int, float, bool or string, as a single cell would be read."""
    s = F.trim(c)
    return F.when(s.rlike(r"^[+-]?\d+$"), "int").when(s.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"), "float").when(F.lower(s).isin("true", "false"), "bool").otherwise("string")


def safe_divide(a: Column, b: Column, default: float = float("inf")) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(default))


def clamp(c: Column, low: float | None = None, high: float | None = None) -> Column:
    c = F.greatest(c, F.lit(low)) if low is not None else c
    return F.least(c, F.lit(high)) if high is not None else c


def safe_log(x: Column, base: float | None = None, default: float = float("-inf")) -> Column:
    """The logarithm, natural at default; the default value where there is none."""
    x = x.cast("double")
    return F.when(x > 0, F.ln(x) / F.lit(1.0 if base is None else math.log(base))).otherwise(F.lit(default))


def floor_divide(a: Column, b: Column) -> Column:
    """The quotient rounded down, also below 0."""
    return F.floor(a / b)


def signed_log_add(sign_a: Column, log_a: Column, sign_b: Column, log_b: Column) -> Column:
    """(sign, log) of a + b, each given by its sign and the logarithm of its size; sign 0 is zero."""
    top, low = F.greatest(log_a, log_b), F.least(log_a, log_b)
    sign = F.when(log_a >= log_b, sign_a).otherwise(sign_b)
    size = F.when(sign_a == sign_b, top + F.ln(1 + F.exp(low - top))).otherwise(top + safe_log(1 - F.exp(low - top)))
    zero = (sign_a == -sign_b) & (log_a == log_b)
    got = F.struct(F.when(zero, 0).otherwise(sign).cast("int").alias("sign"), F.when(zero, F.lit(float("-inf"))).otherwise(size).alias("log"))
    given = lambda s, x: F.struct(s.cast("int").alias("sign"), x.cast("double").alias("log"))
    return F.when(sign_a == 0, given(sign_b, log_b)).when(sign_b == 0, given(sign_a, log_a)).otherwise(got)


def steps(start: Column, end: Column, step: float) -> Column:
    """The array start, start + step, ... below end."""
    n = F.greatest(F.lit(0), F.ceil((end - start) / step)).cast("int")
    every = F.transform(F.sequence(F.lit(0), n), lambda i: start + i * step)
    return F.filter(every, lambda x: x < end)


def positions(a: Column, keep) -> Column:
    """The places (from 0) of the elements of an array for which keep(element) is true."""
    at = F.transform(a, lambda x, i: F.when(keep(x), i))
    return F.filter(at, lambda i: i.isNotNull())


def count_where(a: Column, keep) -> Column:
    return F.size(positions(a, keep))


def named_groups(c: Column, pattern: str) -> Column:
    """The named groups (?<name>...) of the first match as a map; empty without a match."""
    names = re.findall(r"\(\?P?<([A-Za-z]\w*)>", pattern)
    plain = re.sub(r"\(\?P<", "(?<", pattern)
    order = list(re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", plain)).groupindex.items())
    pairs = [x for n, i in order if n in names for x in (F.lit(n), F.regexp_extract(c, plain, i))]
    return F.when(c.rlike(plain), F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,string>"))


def exponential(u: Column, rate) -> Column:
    """An exponential variate of a uniform one (0 <= u < 1)."""
    return -F.ln(1 - u) / rate


def poisson(u: Column, mean: float, most: int = 1000) -> Column:
    """A Poisson variate of a uniform one by inversion: how many cumulative chances u reaches."""
    term, total, chances = math.exp(-mean), 0.0, []
    for k in range(most):
        total += term
        chances.append(total)
        term *= mean / (k + 1)
        if k > mean and total + term == total:
            break
    return F.size(F.filter(F.array(*(F.lit(x) for x in chances)), lambda x: x <= u))


def jitter(c: Column, u: Column, radius: float) -> Column:
    return c + (2 * u - 1) * radius
