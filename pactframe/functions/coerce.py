"""Coercion."""

from __future__ import annotations

import enum

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.plans.nodes import SchemaError, check, comparable, equals, numeric, sized, text, transform

# Words for true and false.
TRUE, FALSE = ["1", "true", "yes", "on", "enable"], ["0", "false", "no", "off", "disable"]
FLOAT = r"^\s*[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


@transform("coerce", "expected_type")
def Coerce(c, t, type):
    """By the rules of the type: numbers from text are told by their form, as casts take more."""
    if isinstance(type, __builtins__["type"] if isinstance(__builtins__, dict) else __builtins__.type) and issubclass(type, enum.Enum):
        hit = F.lit(False)
        for m in type:
            hit = hit | equals(c, t, m.value)
        return c, t, hit
    if type is int:
        if text(t):
            out = F.when(c.rlike(r"^\s*[+-]?\d+(?:_\d+)*\s*$"), F.regexp_replace(F.trim(F.regexp_replace(c, r"\s", "")), "_", "").try_cast("long"))
        else:
            out = c.try_cast("long") if numeric(t) or isinstance(t, T.BooleanType) else F.lit(None).cast("long")
            if isinstance(t, (T.DoubleType, T.FloatType)):
                out = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), out)
        return out, T.LongType(), out.isNotNull()
    if type is float:
        out = F.when(c.rlike(FLOAT), F.regexp_replace(F.regexp_replace(c, r"[\s_]", ""), "(?i)^([+-]?)inf(?:inity)?$", "$1Infinity").try_cast("double")) if text(t) else c.try_cast("double") if numeric(t) else F.lit(None).cast("double") if not isinstance(t, T.BooleanType) else c.cast("int").cast("double")
        return out, T.DoubleType(), out.isNotNull()
    if type is str:
        if isinstance(t, T.BooleanType):
            return F.when(c, "True").otherwise("False"), T.StringType(), None
        return c.cast("string"), T.StringType(), None
    if type is bool:
        n = sized(c, t)
        return (n > 0 if n is not None else c.cast("boolean")), T.BooleanType(), None
    raise SchemaError(f"no coercion to {type}")


@transform("boolean", "expected_boolean")
def Boolean(c, t):
    """Words for true and false in any case; other values by whether they are 0 or empty."""
    if text(t):
        low = F.lower(c)
        out = F.when(low.isin(TRUE), True).when(low.isin(FALSE), False)
        return out, T.BooleanType(), out.isNotNull()
    n = sized(c, t)
    return (n > 0 if n is not None else c.cast("boolean")), T.BooleanType(), None


@transform("value", "expected_number")
def Number(c, t, precision=None, scale=None, yield_decimal=False):
    """A numeric string with exact numbers of digits, all and behind the point."""
    form = c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$") if text(t) else F.lit(False)
    digits, behind = F.regexp_count(c.cast("string"), F.lit(r"\d")), F.length(F.regexp_extract(c.cast("string"), r"\.(\d*)$", 1))
    ok = form
    if precision is not None:
        ok = ok & (digits == precision)
    if scale is not None:
        ok = ok & (behind == scale)
    if not yield_decimal:
        return c, t, ok
    kind = T.DecimalType(38, scale if scale is not None else 18)
    out = c.try_cast(kind)
    return out, kind, ok & out.isNotNull()


@transform("value")
def SetTo(c, t, value):
    """A constant."""
    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value), t)
    return F.lit(value).cast(kind), kind, None


@transform("value", null=True)
def DefaultTo(c, t, default):
    """Null becomes a value."""
    return F.coalesce(c, F.lit(default).cast(t)), t, None


PASSTHROUGH = type("PassThrough", (), {})()
_NONE = object()


@transform("value", "not_in_list")
def Map(c, t, mapping, default=_NONE):
    """Looked up; a miss is an error, a default, or stays."""
    kinds = {type(x) for x in mapping.values() if x is not None}
    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}.get(kinds.pop(), T.StringType()) if len(kinds) == 1 else T.StringType()
    known = [(k, x) for k, x in mapping.items() if comparable(t, k)]
    there, out = F.lit(False), F.lit(None).cast(kind)
    for k, x in known:
        there = there | equals(c, t, k)
        out = F.when(equals(c, t, k), F.lit(x).cast(kind)).otherwise(out)
    if default is PASSTHROUGH:
        return F.when(there, out).otherwise(c.cast(kind)), kind, None
    if default is not _NONE:
        return F.when(there, out).otherwise(F.lit(default).cast(kind)), kind, None
    return out, kind, there


@transform("value")
def EmptyToNone(c, t):
    """Empty becomes null; 0 and false stay."""
    n = sized(c, t)
    return (c if n is None else F.when(n > 0, c)), t, None


@check("not_true", "expected_true")
def IsTrue(c, t):
    """Not 0, not empty."""
    n = sized(c, t)
    return n > 0 if n is not None else c.cast("boolean")


@check("not_false", "expected_false")
def IsFalse(c, t):
    """0 or empty."""
    n = sized(c, t)
    return n == 0 if n is not None else ~c.cast("boolean")
