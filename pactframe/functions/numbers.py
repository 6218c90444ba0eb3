"""Transforms of numbers. Booleans and strings aren't numbers; overflow is an error of the row."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.plans.nodes import SchemaError, check, integral, numeric, text, transform, verified

DOUBLE, LONG = T.DoubleType(), T.LongType()


def _nonzero(**params):
    if any(params.get(k) == 0 for k in ("divisor", "step", "n")) or "in_lo" in params and params["in_lo"] == params["in_hi"]:
        raise SchemaError("division by 0")


def _no(c, t):
    return c, t, F.lit(False)


def _kind(t, *numbers):
    return LONG if integral(t) and all(isinstance(x, int) for x in numbers) else DOUBLE


def _finite(c, t):
    return ~F.isnan(c) & (F.abs(c) != float("inf")) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(True)


@transform("value", "expected_number")
def Clamp(c, t, min=None, max=None):
    """Pinned into a range; NaN stays."""
    if not numeric(t):
        return _no(c, t)
    out, nan = F, F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else F.lit(False)
    out = F.when(nan, c)
    if min is not None:
        out = out.when(c < min, F.lit(min).cast(t))
    if max is not None:
        out = out.when(c > max, F.lit(max).cast(t))
    return out.otherwise(c), t, None


def _arithmetic(op):
    def make(c, t, x):
        if not numeric(t):
            return _no(c, t)
        kind = _kind(t, x)
        out = op(c.cast(kind), F.lit(x).cast(kind))
        return out, kind, out.isNotNull()

    return make


@transform("value", "expected_number")
def Multiply(c, t, factor):
    """Times a factor; whole numbers stay whole."""
    return _arithmetic(F.try_multiply)(c, t, factor)


@transform("value", "expected_number")
def Offset(c, t, amount):
    """Plus an amount."""
    return _arithmetic(F.try_add)(c, t, amount)


@transform("value", "expected_number")
@verified(_nonzero)
def Divide(c, t, divisor):
    """Over a divisor, always a double."""
    return (c.cast("double") / F.lit(float(divisor)), DOUBLE, None) if numeric(t) else _no(c, t)


def _rounded(c, ndigits):
    return F.bround(c, ndigits or 0).cast("long" if ndigits is None else "double"), LONG if ndigits is None else DOUBLE


@transform("value", "expected_number")
def Round(c, t, ndigits=None):
    """Half to even; without digits a whole number."""
    if not numeric(t):
        return _no(c, t)
    if integral(t) and ndigits is None:
        return c.cast("long"), LONG, None
    out, kind = _rounded(c, ndigits)
    return out, kind, _finite(c, t)


@transform("value", "expected_number")
@verified(_nonzero)
def Scale(c, t, factor, divisor=1, offset=0, round=None):
    """value * factor / divisor + offset, rounded if asked."""
    if not numeric(t):
        return _no(c, t)
    out = c.cast("double") * float(factor)
    out = (out / float(divisor) if divisor != 1 else out) + float(offset)
    return (out if round is None else F.bround(out, round)), DOUBLE, None


@transform("value", "expected_number")
@verified(_nonzero)
def Remap(c, t, in_lo, in_hi, out_lo, out_hi):
    """From one range to another, linearly, not pinned."""
    return ((c.cast("double") - float(in_lo)) * float(out_hi - out_lo) / float(in_hi - in_lo) + float(out_lo), DOUBLE, None) if numeric(t) else _no(c, t)


@transform("value", "expected_number")
@verified(_nonzero)
def Snap(c, t, step):
    """To the nearest multiple."""
    return (F.bround(c.cast("double") / float(step), 0) * float(step), DOUBLE, _finite(c, t)) if numeric(t) else _no(c, t)


@transform("value", "expected_number")
def RoundUp(c, t):
    """The next whole number above."""
    return (F.ceil(c).cast("long"), LONG, _finite(c, t)) if numeric(t) else _no(c, t)


@transform("value", "expected_number")
def RoundDown(c, t):
    """The next whole number below."""
    return (F.floor(c).cast("long"), LONG, _finite(c, t)) if numeric(t) else _no(c, t)


@transform("value", "expected_number")
def Abs(c, t):
    """Magnitude."""
    return (F.abs(c.cast(_kind(t))), _kind(t), None) if numeric(t) else _no(c, t)


@transform("value", "expected_number")
@verified(_nonzero)
def Modulo(c, t, n):
    """The rest, with the sign of the divisor."""
    if not numeric(t):
        return _no(c, t)
    k, m = _kind(t, n), F.lit(n).cast(_kind(t, n))
    return (c.cast(k) % m + m) % m, k, None


def _percentage(c, t):
    if text(t):
        n = F.regexp_replace(F.trim(c), r"\s*%$", "")
        out = F.when(n.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.expr("1").cast("double") * n.try_cast("double"))
    else:
        out = c.cast("double") if numeric(t) else F.lit(None).cast("double")
    return out, F.coalesce((out >= 0) & (out <= 100) & ~F.isnan(out), F.lit(False))


@check("value", "expected_percentage")
def Percentage(c, t):
    """A number or "NN%" from 0 to 100, as it is."""
    return _percentage(c, t)[1]


@transform("value", "expected_percentage")
def FromPercentage(c, t):
    """A number or "NN%" from 0 to 100, as a double."""
    out, ok = _percentage(c, t)
    return out, DOUBLE, ok
