"""Network names, identifiers, encodings, checksummed formats."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.functions.strings import _own
from pactframe.plans.nodes import check, integral, numeric, text, transform

STRING = T.StringType()
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"

IPv4Address = _own(rf"\A{V4}\z", "ip", "expected_ipv4")


def _v6(c):
    """Eight groups, one run of which may be left out; the last two may be an IPv4 address; a zone may follow."""
    bare = F.regexp_replace(c, r"%[^%/]+\z", "")
    plain = F.regexp_replace(bare, rf":{V4}\z", ":0:0")
    groups = F.size(F.filter(F.split(plain, ":"), lambda x: F.length(x) > 0))
    form = plain.rlike(r"\A(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?)\z")
    return form & F.when(plain.contains("::"), groups <= 7).otherwise(groups == 8)


@check("ip", "expected_ipv6")
def IPv6Address(c, t):
    """An IPv6 address."""
    return _v6(c) if text(t) else F.lit(False)


@check("ip", "expected_ip")
def IPAddress(c, t):
    """An address of either kind."""
    return c.rlike(rf"\A{V4}\z") | _v6(c) if text(t) else F.lit(False)


@check("ip", "expected_cidr")
def IPNetwork(c, t):
    """An address and perhaps a number of bits; host bits may be set."""
    if not text(t):
        return F.lit(False)
    host, bits = F.split_part(c, F.lit("/"), F.lit(1)), F.regexp_extract(c, r"/(\d{1,3})\z", 1).try_cast("int")
    none = ~c.contains("/")
    return (host.rlike(rf"\A{V4}\z") & (none | F.coalesce(bits <= 32, F.lit(False)))) | (_v6(host) & (none | F.coalesce(bits <= 128, F.lit(False))))


@check("hostname", "expected_hostname")
def Hostname(c, t):
    """Labels of 63 characters, 253 in all; a dot may end it."""
    return c.rlike(rf"\A{LABEL}(?:\.{LABEL})*\.?\z") & (F.length(F.rtrim(c, F.lit("."))) <= 253) if text(t) else F.lit(False)


@check("hostname", "expected_fqdn")
def Fqdn(c, t):
    """A host name with a dot inside."""
    return c.rlike(rf"\A{LABEL}(?:\.{LABEL})+\.?\z") & (F.length(F.rtrim(c, F.lit("."))) <= 253) if text(t) else F.lit(False)


@transform("range", "expected_port")
def Port(c, t):
    """1 to 65535, as a whole number."""
    if text(t):
        out = F.when(c.rlike(r"\A\s*\+?\d+\s*\z"), c.try_cast("long"))
    elif numeric(t):
        out = c.try_cast("long") if integral(t) else F.when(c == F.floor(c), c.try_cast("long"))
    else:
        out = F.lit(None).cast("long")
    return out, T.LongType(), (out >= 1) & (out <= 65535)


@check("uuid", "expected_uuid")
def UUID(c, t, version=None):
    """Any written form of a UUID."""
    if not text(t):
        return F.lit(False)
    bare = F.regexp_replace(c, r"urn:|uuid:|[{}-]", "")
    ok = bare.rlike(r"\A[0-9a-fA-F]{32}\z")
    return ok if version is None else ok & (F.substring(bare, 13, 1) == f"{version:x}") & F.lower(F.substring(bare, 17, 1)).isin(["8", "9", "a", "b"])


ULID = _own(r"(?i)\A[0-7][0-9A-HJKMNP-TV-Z]{25}\z", "ulid", "expected_ulid")
MAC = r"\A(?:[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{4}(?:\.[0-9A-Fa-f]{4}){2}|[0-9A-Fa-f]{12})\z"
MacAddress = _own(MAC, "mac_address", "expected_mac_address")


@transform("mac_address", "expected_mac_address")
def NormalizeMacAddress(c, t, upper=False, separator=":"):
    """With one separator and case."""
    if not text(t):
        return c, t, F.lit(False)
    bare = F.regexp_replace(F.lower(c), "[^0-9a-f]", "")
    out = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(bare, i * 2 + 1, F.lit(2))), separator)
    return (F.upper(out) if upper else out), STRING, c.rlike(MAC)


Base64 = _own(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z", "base64", "expected_base64_string")
Hex = _own(r"\A\s*(?:[0-9A-Fa-f]{2}\s*)*\z", "hex", "expected_hex_string")


@transform("hex_int", "expected_hexadecimal_integer")
def HexInt(c, t):
    """Text of base 16, or a whole number."""
    if integral(t):
        return c.cast("long"), T.LongType(), None
    if not text(t):
        return c, t, F.lit(False)
    form = r"\A\s*([+-]?)(?:0[xX])?([0-9A-Fa-f]{1,15})\s*\z"
    n = F.conv(F.regexp_extract(c, form, 2), 16, 10).try_cast("long")
    out = F.when(c.rlike(form), F.when(F.regexp_extract(c, form, 1) == "-", -n).otherwise(n))
    return out, T.LongType(), out.isNotNull()


@transform("credit_card", "expected_credit_card_number")
def CreditCard(c, t, normalize=False):
    """12 to 19 digits whose check digit is right; spaces and dashes may part them."""
    if not text(t):
        return c, t, F.lit(False)
    bare = F.regexp_replace(c, "[ -]", "")
    return (bare if normalize else c), STRING, bare.rlike(r"\A\d{12,19}\z") & F.call_function("luhn_check", bare)


@transform("iban", "expected_iban")
def IBAN(c, t, normalize=False):
    """Its number leaves 1 modulo 97."""
    if not text(t):
        return c, t, F.lit(False)
    bare = F.upper(F.regexp_replace(c, " ", ""))
    moved = F.concat(F.substring(bare, 5, 100), F.left(bare, F.lit(4)))

    def add(acc, x):
        n = F.ascii(x)
        return F.when(n >= 65, (acc * 100 + n - 55) % 97).otherwise((acc * 10 + n - 48) % 97)

    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda acc, x: F.when(F.length(x) == 0, acc).otherwise(add(acc, x)))
    return (bare if normalize else c), STRING, bare.rlike(r"\A[A-Z]{2}\d{2}[A-Z0-9]{11,30}\z") & (rest == 1)


@check("data_uri", "expected_data_uri")
def DataURI(c, t):
    """data:, a media type, perhaps ;base64, and data."""
    if not text(t):
        return F.lit(False)
    head = r"\Adata:(?:[A-Za-z0-9!#$&^_.+-]+/[A-Za-z0-9!#$&^_.+-]+)?(?:;[A-Za-z0-9!#$&^_.+-]+=[^;,]+)*"
    plain = c.rlike(head + r",[^\s]*\z")
    return plain | c.rlike(head + r";base64,(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")


@transform("e164", "expected_phone_number")
def E164(c, t, normalize=False):
    """A plus and 2 to 15 digits; spaces, dots, dashes and brackets may part them."""
    if not text(t):
        return c, t, F.lit(False)
    bare = F.regexp_replace(c, r"[\s().-]", "") if normalize else c
    return bare, STRING, bare.rlike(r"\A\+[1-9]\d{1,14}\z")


@check("json", "expected_json_string")
def JSONString(c, t):
    """Text that is JSON."""
    return F.try_parse_json(c).isNotNull() if text(t) else F.lit(False)
