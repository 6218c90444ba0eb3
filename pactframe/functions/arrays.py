"""Arrays as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.plans.nodes import check, equals, text, transform


def _is(t):
    return isinstance(t, T.ArrayType)


def _whole(c):
    return ~F.exists(c, lambda x: x.isNull())


@check("sorted", "expected_sorted")
def Sorted(c, t):
    """Ascending; null items can't be ordered."""
    return _whole(c) & (c == F.array_sort(c)) if _is(t) else F.lit(False)


@transform("value", "cannot_sort")
def Sort(c, t, reverse=False):
    """In order."""
    return (F.sort_array(c, not reverse), t, _whole(c)) if _is(t) else (c, t, F.lit(False))


@check("value", "contains_duplicate_items")
def Unique(c, t):
    """No item twice."""
    return F.size(F.array_distinct(c)) == F.size(c) if _is(t) else F.lit(False)


@transform("value", "expected_collection")
def Dedupe(c, t):
    """Each item once, where it was first."""
    return (F.array_distinct(c), t, None) if _is(t) else (c, t, F.lit(False))


Set = Dedupe


@transform("value", "must_not_be_empty")
def First(c, t):
    """The first item."""
    return (F.get(c, F.lit(0)), t.elementType, F.size(c) > 0) if _is(t) else (c, t, F.lit(False))


@transform("value", "must_not_be_empty")
def Last(c, t):
    """The last item."""
    return (F.try_element_at(c, F.lit(-1)), t.elementType, F.size(c) > 0) if _is(t) else (c, t, F.lit(False))


@transform("value", "expected_sequence")
def Without(c, t, values):
    """Items that aren't among the values; repeated ones stay."""
    if not _is(t):
        return c, t, F.lit(False)
    return F.filter(c, lambda x: ~reduce(lambda a, b: a | b, [F.coalesce(equals(x, t.elementType, v), F.lit(False)) for v in values], F.lit(False))), t, None


@transform("value", "expected_string")
def Split(c, t, sep=",", strip=True, drop_empty=True):
    """Parts between separators."""
    if not text(t):
        return c, t, F.lit(False)
    out = F.split(c, "".join(f"\\x{{{ord(x):x}}}" for x in sep), -1)
    out = F.transform(out, lambda x: F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")) if strip else out
    return (F.filter(out, lambda x: F.length(x) > 0) if drop_empty else out), T.ArrayType(T.StringType()), None


@transform("value", "expected_sequence")
def Join(c, t, sep=","):
    """Items as text, joined; null is written None."""
    return (F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None"))), sep), T.StringType(), None) if _is(t) else (c, t, F.lit(False))


@transform("value", null=True)
def EnsureList(c, t):
    """Null becomes an empty array, a single value an array of it."""
    if _is(t):
        return F.coalesce(c, F.array().cast(t)), t, None
    return F.when(c.isNull(), F.array().cast(T.ArrayType(t))).otherwise(F.array(c)), T.ArrayType(t), None


