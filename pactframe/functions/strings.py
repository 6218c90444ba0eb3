"""Strings."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.plans.nodes import SchemaError, check, text, transform, verified

STRING = T.StringType()


def java(pattern: str) -> str:
    """A Python pattern for the JVM: named groups, the end of the text, and classes that cover Unicode."""
    try:
        re.compile(pattern)
    except (re.error, TypeError) as e:
        raise SchemaError(f"bad pattern {pattern!r}: {e}") from None
    out = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\\\k<{m[1].replace('_', '')}>", out)
    return "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)


def _pattern(pattern, **_):
    java(pattern if isinstance(pattern, str) else pattern.pattern)


def _own(pattern: str, code: str, key: str):
    """A check by a fixed pattern over the whole text."""

    def rule(c, t):
        return c.rlike(pattern) if text(t) else F.lit(False)

    rule.__name__ = key
    return check(code, key)(rule)


@check("match", "does_not_match_pattern")
@verified(_pattern)
def Match(c, t, pattern):
    """Matches from its beginning."""
    return c.rlike(rf"\A(?:{java(pattern if isinstance(pattern, str) else pattern.pattern)})") if text(t) else F.lit(False)


@transform("value", "expected_string")
@verified(_pattern)
def Replace(c, t, pattern, substitution):
    """All matches replaced; groups as in Python."""
    sub = substitution.replace("$", r"\$")
    sub = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1].replace('_', '')}}}", sub)
    sub = re.sub(r"\\(\d)", r"$\1", sub)
    return (F.regexp_replace(c, java(pattern), sub), STRING, None) if text(t) else (c, t, F.lit(False))


def _ends(test):
    def rule(c, t, part):
        if not text(t):
            return F.lit(False)
        out = F.lit(False)
        for p in part if isinstance(part, tuple) else (part,):
            out = out | test(c, p)
        return out

    return rule


@check("value", "must_start_with")
def StartsWith(c, t, prefix):
    """Begins with a text or one of several."""
    return _ends(lambda c, p: c.startswith(p))(c, t, prefix)


@check("value", "must_end_with")
def EndsWith(c, t, suffix):
    """Ends with a text or one of several."""
    return _ends(lambda c, p: c.endswith(p))(c, t, suffix)


@check("length", "byte_length_out_of_bounds")
def ByteLength(c, t, min=None, max=None):
    """Bytes in UTF-8."""
    if not text(t) and not isinstance(t, T.BinaryType):
        return F.lit(False)
    n, ok = F.octet_length(c), F.lit(True)
    ok = ok & (n >= min) if min is not None else ok
    return ok & (n <= max) if max is not None else ok


Alpha = _own(r"\A[A-Za-z]+\z", "value", "expected_alpha")
Alphanumeric = _own(r"\A[A-Za-z0-9]+\z", "value", "expected_alphanumeric")
ASCII = _own(r"\A[\x00-\x7f]*\z", "value", "expected_ascii")
PrintableASCII = _own(r"\A[\x20-\x7e]*\z", "value", "expected_printable_ascii")
NoWhitespace = _own(r"(?U)\A\S*\z", "value", "expected_no_whitespace")
HexColor = _own(r"\A#(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6})\n?\z", "match", "expected_hex_color")
Slug = _own(r"\A[a-z0-9](?:[a-z0-9_-]*[a-z0-9])?\z", "slug", "expected_slug")
Email = _own(r"(?i)\A(?!\.)(?:\.?[a-z0-9!#$%&'*+/=?^_`{|}~-]+)+@(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])\.?\z", "email", "expected_email_address")
Url = _own(r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", "url", "expected_url")
FqdnUrl = _own(r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*\.[^/?#]*", "url", "expected_fqdn_url")


def _change(name, fn):
    """A transform of the value as text."""

    def rule(c, t):
        return fn(F.when(c, "True").otherwise("False") if isinstance(t, T.BooleanType) else c.cast("string")), STRING, None

    rule.__name__ = name
    return transform("value")(rule)


Lower, Upper = _change("Lower", F.lower), _change("Upper", F.upper)
Capitalize = _change("Capitalize", lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substring(c, 2, 2**31 - 1))))
Strip = _change("Strip", lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", ""))
#: Words are runs of letters: each begins upper case, what follows in it is lower case.
Title = _change("Title", lambda c: F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"(?U)(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""))


@transform("value", "expected_string")
def CollapseWhitespace(c, t):
    """Runs of white space become one space, none at the ends."""
    return (F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), STRING, None) if text(t) else (c, t, F.lit(False))


@transform("value", "expected_string")
def RemovePrefix(c, t, prefix):
    """Without a beginning, if it is there."""
    return (F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c), STRING, None) if text(t) else (c, t, F.lit(False))


@transform("value", "expected_string")
def RemoveSuffix(c, t, suffix):
    """Without an end, if it is there."""
    return (F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c), STRING, None) if text(t) else (c, t, F.lit(False))


@transform("value", "expected_string")
def Truncate(c, t, length):
    """The first code points."""
    return (F.left(c, F.lit(length)), STRING, None) if text(t) else (c, t, F.lit(False))
