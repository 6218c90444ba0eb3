"""Comparison, membership and length."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.plans.nodes import SchemaError, check, comparable, equals, numeric, sized, text, transform, verified


def _bounded(c, t, low, high):
    """A comparison that NaN fails, or None where the bounds can't be compared with the type."""
    if any(b is not None and not comparable(t, b) for b in (low, high)):
        return None
    return ~F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(True)


@check("range")
def Range(c, t, min=None, max=None, min_included=True, max_included=True):
    """Between bounds; the lower one is told first. NaN is in no range."""
    guard = _bounded(c, t, min, max)
    if guard is None:
        return F.lit(False)
    held = []
    if min is not None:
        held.append((guard & (c >= F.lit(min) if min_included else c > F.lit(min)), "range_min" if min_included else "range_min_exclusive"))
    if max is not None:
        held.append((guard & (c <= F.lit(max) if max_included else c < F.lit(max)), "range_max" if max_included else "range_max_exclusive"))
    return held or F.lit(True)


def _fixed(low, high, low_included=True, high_included=True):
    def make(msg=None):
        return Range(low, high, low_included, high_included, msg=msg)

    make.rule = Range.rule
    return make


Positive, NonNegative, Negative = _fixed(0, None, False), _fixed(0, None), _fixed(None, 0, True, False)
Byte, SmallFloat, Latitude, Longitude = _fixed(0, 255), _fixed(0, 1), _fixed(-90, 90), _fixed(-180, 180)


@check("value", "value_not_equal")
def Equal(c, t, target):
    """Equal to a value."""
    return equals(c, t, target)


@transform("not_valid", "expected_type")
def Literal(c, t, lit):
    """Equal to a value, which is the result."""
    return F.lit(lit).cast(t) if comparable(t, lit) else c, t, equals(c, t, lit)


def _whole_factor(factor):
    if isinstance(factor, bool) or not isinstance(factor, int) or factor == 0:
        raise SchemaError("the factor must be a whole number other than 0")


@check("multiple_of")
@verified(_whole_factor)
def MultipleOf(c, t, factor):
    """A whole multiple."""
    return F.coalesce(F.try_mod(c, F.lit(factor)) == 0, F.lit(False)) if numeric(t) else F.lit(False)


@check("length")
def Length(c, t, min=None, max=None):
    """Code points of a string, items of an array or a map."""
    if min is None and max is None:
        return F.lit(True)
    n = sized(c, t)
    if n is None:
        return F.lit(False)
    held = [(n >= min, "length_min")] if min is not None else []
    return held + ([(n <= max, "length_max")] if max is not None else [])


@check("length", "must_not_be_empty")
def NonEmpty(c, t):
    """Not empty."""
    n = sized(c, t)
    return F.lit(False) if n is None else n > 0


@check("contains", "value_must_contain")
def Contains(c, t, item):
    """Holds a part, an item or a key."""
    if text(t):
        return c.contains(F.lit(item)) if isinstance(item, str) else F.lit(False)
    if isinstance(t, T.ArrayType):
        return F.array_contains(c, F.lit(item)) if comparable(t.elementType, item) else F.lit(False)
    if isinstance(t, T.MapType):
        return F.map_contains_key(c, F.lit(item)) if comparable(t.keyType, item) else F.lit(False)
    return F.lit(False)


def _member(c, t, container):
    plain = [x for x in container if x is not None and comparable(t, x) and not isinstance(x, bool)]
    odd = [equals(c, t, x) for x in container if isinstance(x, bool)]
    hits = ([c.isin(plain)] if plain else []) + odd
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)) if hits else F.lit(False)


@transform("not_in_list", "not_in_list")
def In(c, t, container, fold_case=False, space=False):
    """A member. Folding case or white space gives the folded value."""
    if (fold_case or space) and text(t):
        if space:
            c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
        if fold_case:
            c = F.lower(c)
    return c, t, _member(c, t, list(container))


@check("in_list", "in_list")
def NotIn(c, t, container):
    """No member."""
    return ~_member(c, t, list(container))
