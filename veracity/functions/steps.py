"""Per-step arrays as column expressions. Wide vocabulary axes stay arrays; they are never exploded."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
LEAST_MASS = 1e-12
#: Digits in the widest sense: decimal ones of all scripts, and superscripts, circled ones and the like.
DIGIT = r"\p{Nd}\x{11f50}-\x{11f59}\x{16ac0}-\x{16ac9}\x{1e4f0}-\x{1e4f9}" + "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdigit() and not c.isdecimal())


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row. Expressions inside an array function are evaluated anew
    for each element, so what they share is bound to a variable first."""
    return F.get(F.transform(F.array(value), use), 0)


def _log_sum_exp(v: Column, top: Column) -> Column:
    total = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(F.size(v) == 0, F.lit(float("-inf"))).when(F.isnan(top) | (F.abs(top) == float("inf")), top).otherwise(F.log(total) + top)


def log_sum_exp(v: Column) -> Column:
    """Shifted by the maximum; -inf if empty; a maximum that isn't finite is the result."""
    return once(v, lambda z: once(F.array_max(z), lambda top: _log_sum_exp(z, top)))


def _doubles(logits: Column) -> Column:
    return F.transform(logits, lambda x: x.cast("double"))


def step_statistics(logits: Column) -> Column:
    """entropy, max_probability and margin of the softmax, as a struct. Three passes over the array."""
    none = F.lit(float("-inf"))

    def two_largest(z: Column) -> Column:
        start = F.struct(none.alias("first"), none.alias("second"))
        return F.aggregate(z, start, lambda s, x: F.struct(F.greatest(s["first"], x).alias("first"), F.greatest(s["second"], F.least(s["first"], x)).alias("second")))

    def made(z: Column, top: Column, log_total: Column) -> Column:
        entropy = F.aggregate(z, F.lit(0.0), lambda a, x: a - F.exp(x - log_total) * (x - log_total))
        first, second = F.exp(top["first"] - log_total), F.exp(top["second"] - log_total)
        return F.struct(entropy.alias("entropy"), F.when(F.size(z) > 0, first).alias("max_probability"), F.when(F.size(z) > 0, first - F.when(F.size(z) > 1, second).otherwise(0.0)).alias("margin"))

    return once(_doubles(logits), lambda z: once(two_largest(z), lambda top: once(_log_sum_exp(z, top["first"]), lambda log_total: made(z, top, log_total))))


def chosen_log_probability(logits: Column, chosen: Column) -> Column:
    return once(_doubles(logits), lambda z: F.get(z, chosen.cast("int")) - log_sum_exp(z))


def mean_log_probability(log_probabilities: Column) -> Column:
    """The mean of a sequence's log-probabilities, which compares sequences of any length; NaN for an empty one."""
    return F.when(F.size(log_probabilities) == 0, F.lit(NAN)).otherwise(F.aggregate(log_probabilities, F.lit(0.0), lambda a, x: a + x) / F.size(log_probabilities))


def shannon_entropy(masses: Column) -> Column:
    """In nats, renormalised; NaN if empty or without mass; tiny shares don't count."""
    total = F.aggregate(masses, F.lit(0.0), lambda a, x: a + x)
    part = lambda a, x: a - F.when(x / total > LEAST_MASS, x / total * F.log(x / total)).otherwise(0.0)
    return F.when((F.size(masses) == 0) | (total <= LEAST_MASS), F.lit(NAN)).otherwise(F.aggregate(masses, F.lit(0.0), part))


def normalized_entropy(entropy: Column, vocabulary: Column) -> Column:
    return F.when(vocabulary <= 1, F.lit(0.0)).otherwise(entropy / (F.log(vocabulary.cast("double")) + LEAST_MASS))


def slice_to_span(values: Column, span: Column) -> Column:
    """values[start:end] with clamping; all without a span; empty where start >= end."""
    start = F.greatest(F.lit(0), span["start"])
    length = F.greatest(F.lit(0), F.least(F.size(values), span["end"]) - start)
    return F.when(span.isNull(), values).otherwise(F.slice(values, start + 1, length))


def effective_length(tokens: Column, ends: Column) -> Column:
    """Tokens up to and with the first end token."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(F.array_contains(ends, t), i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.get(at, 0), F.size(tokens))


def answer_span(pieces: Column, marker: str = "####") -> Column:
    """struct(start, end) of the answer in an array of token texts: from the first token after the last
    marker that some digit follows. Marker places may overlap, while the count of markers in a
    prefix may not, so an overlapping run of marker characters can leave no span (null)."""
    n = len(marker)
    mark = re.escape(marker)

    def found(text: Column) -> Column:
        # A marker counts if it ends before the last digit; these may overlap, so they are counted by look-ahead.
        before = F.greatest(F.length(text) - F.length(F.regexp_extract(F.reverse(text), f"^[^{DIGIT}]*", 0)) - 1, F.lit(0))
        needed = F.regexp_count(F.substr(text, F.lit(1), before), F.lit(f"(?={mark})"))
        return once(needed, lambda k: once(F.split(text, mark), lambda parts: reach(parts, k)))

    def reach(parts: Column, needed: Column) -> Column:
        """Characters up to the end of the needed-th marker that overlaps none before it; null if there is none."""
        length = F.aggregate(F.slice(parts, F.lit(1), needed), F.lit(0), lambda a, p: a + F.length(p) + n)
        return F.when((needed > 0) & (F.size(parts) > needed), length)

    def first_token(end: Column) -> Column:
        start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("k"))
        return F.aggregate(pieces, start, lambda s, p: F.struct((s["seen"] + F.length(p)).alias("seen"), (s["k"] + F.when(s["seen"] < end, 1).otherwise(0)).alias("k")))["k"]

    return once(found(F.array_join(pieces, "")), lambda end: F.when(end.isNotNull(), F.struct(first_token(end).alias("start"), F.size(pieces).alias("end"))))
