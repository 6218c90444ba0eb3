"""Dates, times, durations, zones. Text forms are told by patterns first, as casts take more."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.plans.nodes import SchemaError, check, numeric, text, transform, verified

# What a directive of strptime is in Spark's patterns (unpadded fields are taken).
DIRECTIVES = {"Y": "yyyy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "[SSSSSS][SSSSS][SSSS][SSS][SS][S]", "p": "a", "b": "MMM", "B": "MMMM", "j": "D", "y": "yy", "a": "E", "A": "EEEE", "z": "xx", "%": "'%'"}


def spark_format(pattern: str) -> str:
    """A strptime format as one of Spark's."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%":
            if pattern[i + 1 : i + 2] not in DIRECTIVES:
                raise SchemaError(f"no equivalent of %{pattern[i + 1 : i + 2]}")
            out += DIRECTIVES[pattern[i + 1]]
            i += 2
        else:
            out += "''" if pattern[i] == "'" else f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return out


def _format(format=None, **_):
    if format is not None:
        spark_format(format)


@check("datetime", "expected_datetime")
@verified(_format)
def Datetime(c, t, format="%Y-%m-%dT%H:%M:%S.%fZ"):
    """Text of a format."""
    return F.try_to_timestamp(c, F.lit(spark_format(format))).isNotNull() if text(t) else F.lit(False)


@check("date", "expected_date")
@verified(_format)
def Date(c, t, format="%Y-%m-%d"):
    """Text of a format."""
    return F.try_to_timestamp(c, F.lit(spark_format(format))).isNotNull() if text(t) else F.lit(False)


@check("time", "expected_time")
@verified(_format)
def Time(c, t, format="%H:%M:%S"):
    """Text of a format."""
    if format != "%H:%M:%S" and text(t):
        return F.try_to_timestamp(c, F.lit(spark_format(format))).isNotNull()
    return c.rlike(r"\A(?:[01]?\d|2[0-3]):[0-5]?\d:(?:[0-5]?\d|6[01])\z") if text(t) else F.lit(False)


ISO_DATE = r"\d{4}-?(?:0[1-9]|1[0-2])-?(?:0[1-9]|[12]\d|3[01])"
ISO_TIME = r"(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?"
ZONE = r"(?:Z|[+-](?:[01]\d|2[0-3]):?[0-5]\d)"


def _dashed(c):
    return F.regexp_replace(F.left(c, F.lit(10)), r"\A(\d{4})(\d{2})(\d{2}).*", "$1-$2-$3")


@transform("datetime", "expected_iso_datetime")
@verified(_format)
def AsDatetime(c, t, format=None, require_timezone=False):
    """ISO 8601 text, or text of a format, as an instant; timestamps stay. An offset is told from the text, or the format."""
    if format is not None and text(t):
        out = F.try_to_timestamp(c, F.lit(spark_format(format)))
        return out, T.TimestampType(), out.isNotNull() & F.lit(not require_timezone or "%z" in format)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return c, t, F.lit(not require_timezone or isinstance(t, T.TimestampType))
    if not text(t):
        return c, t, F.lit(False)
    form = rf"\A{ISO_DATE}(?:[T ]{ISO_TIME}{ZONE}{'' if require_timezone else '?'}){'' if require_timezone else '?'}\z"
    out = F.when(c.rlike(form), F.coalesce(c.try_cast("timestamp"), F.regexp_replace(c, r"\A(\d{4})(\d{2})(\d{2})", "$1-$2-$3").try_cast("timestamp")))
    return out, T.TimestampType(), out.isNotNull()


@transform("date", "expected_iso_date")
@verified(_format)
def AsDate(c, t, format=None):
    """ISO 8601 text, or text of a format, as a date; dates stay, timestamps aren't dates."""
    if format is not None and text(t):
        out = F.try_to_timestamp(c, F.lit(spark_format(format))).cast("date")
        return out, T.DateType(), out.isNotNull()
    if isinstance(t, T.DateType):
        return c, t, None
    if not text(t):
        return c, t, F.lit(False)
    out = F.when(c.rlike(rf"\A{ISO_DATE}\z"), _dashed(c).try_cast("date"))
    return out, T.DateType(), out.isNotNull()


@transform("time", "expected_iso_time")
@verified(_format)
def AsTime(c, t, format=None):
    """ISO 8601 text, or text of a format, as text HH:mm:ss.SSSSSS: Spark's own type of times is off by default. An offset is told to be right and left out."""
    if not text(t):
        return c, t, F.lit(False)
    if format is not None:
        at = F.try_to_timestamp(c, F.lit(spark_format(format)))
    else:
        digits = F.rpad(F.regexp_replace(F.regexp_replace(c, rf"{ZONE}\z", ""), r"[:]|[.,].*", ""), 6, "0")
        part = F.rpad(F.left(F.regexp_extract(c, r"[.,](\d+)", 1), F.lit(6)), 6, "0")
        at = F.when(c.rlike(rf"\A{ISO_TIME}{ZONE}?\z"), F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), digits, part), F.lit("yyyy-MM-dd HHmmssSSSSSS")))
    return F.date_format(at, "HH:mm:ss.SSSSSS"), T.StringType(), at.isNotNull()


CLOCK = r"\A([+-]?)(\d+):([0-5]?\d)(?::([0-5]?\d(?:\.\d+)?))?\z"
ISO_DURATION = r"\A([+-]?)P(?=\d|T\d)(?:(\d+(?:\.\d+)?)W)?(?:(\d+(?:\.\d+)?)D)?(?:T(?=\d)(?:(\d+(?:\.\d+)?)H)?(?:(\d+(?:\.\d+)?)M)?(?:(\d+(?:\.\d+)?)S)?)?\z"


def seconds_of(c, t):
    """Seconds of a duration as a double, null if it is none."""
    if numeric(t):
        return c.cast("double")
    if not text(t):
        return F.lit(None).cast("double")

    def part(pattern, i):
        return F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).try_cast("double"), F.lit(0.0))

    def sign(pattern):
        return F.when(F.regexp_extract(c, pattern, 1) == "-", -1.0).otherwise(1.0)

    clock = sign(CLOCK) * (part(CLOCK, 2) * 3600 + part(CLOCK, 3) * 60 + part(CLOCK, 4))
    iso = sign(ISO_DURATION) * (part(ISO_DURATION, 2) * 604800 + part(ISO_DURATION, 3) * 86400 + part(ISO_DURATION, 4) * 3600 + part(ISO_DURATION, 5) * 60 + part(ISO_DURATION, 6))
    return F.when(c.rlike(r"\A[+-]?\d+(?:\.\d+)?\z"), c.try_cast("double")).when(c.rlike(CLOCK), clock).when(c.rlike(ISO_DURATION), iso)


@transform("duration", "expected_duration_detailed")
def AsTimedelta(c, t):
    """Seconds, H:MM[:SS] or ISO 8601 as an interval of day to second."""
    s = seconds_of(c, t)
    out = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))
    return out, T.DayTimeIntervalType(), s.isNotNull() & ~F.isnan(s)


@check("duration", "expected_duration")
def Duration(c, t):
    """The same forms, unchanged."""
    return seconds_of(c, t).isNotNull()


@check("time_zone", "expected_iana_time_zone")
def TimeZoneInfo(c, t):
    """An IANA name."""
    return c.isin(sorted(zoneinfo.available_timezones())) if text(t) else F.lit(False)


OFFSET = r"\A(?:Z|UTC|[+-](?:[01]\d|2[0-3]):?[0-5]\d)\z"


@check("time_zone", "expected_utc_offset")
def TimeZone(c, t):
    """Z, UTC or an offset below a day."""
    return c.rlike(OFFSET) if text(t) else F.lit(False)


@transform("time_zone", "expected_utc_offset")
def AsTimezone(c, t):
    """An offset as an interval."""
    if not text(t):
        return c, t, F.lit(False)
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, r"\A([+-])(\d{2}):?(\d{2})\z", i), F.lit("")).try_cast("int"), F.lit(0))
    sign = F.when(c.startswith("-"), -1).otherwise(1)
    return F.make_dt_interval(F.lit(0), sign * part(2), sign * part(3), F.lit(0).cast("decimal(18,6)")), T.DayTimeIntervalType(), c.rlike(OFFSET)


def _unit(unit):
    if unit not in ("seconds", "milliseconds"):
        raise SchemaError("the unit is seconds or milliseconds")


@transform("epoch", "expected_unix_timestamp")
@verified(_unit)
def FromEpoch(c, t, unit="seconds"):
    """Seconds or milliseconds since 1970 as an instant, from year 1 to 9999."""
    if not numeric(t):
        return c, t, F.lit(False)
    s = c.cast("double") / (1000.0 if unit == "milliseconds" else 1.0)
    ok = ~F.isnan(s) & (s >= -62135596800) & (s <= 253402300799)
    return F.timestamp_seconds(F.when(ok, s)), T.TimestampType(), ok
