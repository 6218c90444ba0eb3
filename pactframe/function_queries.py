"""Queries over single functions, conversions and contracts made from other forms, with their SQL.

A column that no table has is made of a good and a bad text by the row's number, so that the SQL counts the bad ones by that number.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Annotated, Literal

from pyspark.sql import functions as F

from pactframe import ALLOW_EXTRA, REMOVE_EXTRA, Contract, Self
from pactframe import functions as f
from pactframe.codecs import Key, contract_of, from_json_schema, from_openapi, to_field_list, to_json_schema, to_openapi
from pactframe.operators import rules as r
from pactframe.operators.combinators import All, Maybe
from pactframe.operators.markers import Optional, Required
from pactframe.operators.parsed import FromJSONString
from pactframe.operators.rules import against, transitions
from pactframe.registry import counted, either, query, t

#: name: (check, code, divisor, bad text, good text)
STRINGS = {
    "alpha": (f.Alpha(), "value", 2, "ab1", "ab"),
    "alnum": (f.Alphanumeric(), "value", 3, "a-b", "a1"),
    "ascii": (f.ASCII(), "value", 4, "é", "e~"),
    "printable": (f.PrintableASCII(), "value", 5, "a\tb", "a b"),
    "unspaced": (f.NoWhitespace(), "value", 6, "a b", "a-b"),
    "color": (f.HexColor(), "match", 7, "#12g", "#A0b1C2"),
    "starts": (f.StartsWith("ab"), "value", 8, "ba", "abc"),
    "ends": (f.EndsWith(("z", "yy")), "value", 9, "y", "xyy"),
    "octets": (f.ByteLength(2, 3), "length", 10, "éé", "é"),
    "site": (f.FqdnUrl(), "url", 11, "http://localhost/x.y", "http://a.org/"),
    "pattern": (f.Match("a+"), "match", 12, "ba", "aab"),
    "regex": (f.IsRegex(), "value", 13, "(", "a(?P<x>b)"),
}
NETWORK = {
    "v4": (f.IPv4Address(), "ip", 2, "1.2.3.04", "1.2.3.4"),
    "v6": (f.IPv6Address(), "ip", 3, "1::2::3", "fe80::1"),
    "net": (f.IPNetwork(), "ip", 4, "10.0.0.0/33", "10.0.0.1/8"),
    "host": (f.Hostname(), "hostname", 5, "-a.org", "a-b"),
    "fqdn": (f.Fqdn(), "hostname", 6, "localhost", "a.example.org"),
    "mac": (f.MacAddress(), "mac_address", 7, "00:11-22:33:44:55", "00:11:22:aa:BB:cc"),
    "base64": (f.Base64(), "base64", 9, "YQ", "YQ=="),
    "hex": (f.Hex(), "hex", 10, "abc", "ab cd"),
    "data": (f.DataURI(), "data_uri", 11, "data;x", "data:text/plain,x"),
    "phone": (f.E164(), "e164", 12, "+0123", "+4930123456"),
    "json": (f.JSONString(), "json", 13, "{a", '{"a": [1, null]}'),
}
TIMES = {
    "stamp": (f.Datetime(), "datetime", 2, "2024-02-30T10:00:00.5Z", "2024-02-29T10:00:00.5Z"),
    "own": (f.Datetime("%d/%m/%Y %H:%M"), "datetime", 3, "13/13/2024 10:00", "1/2/2024 9:05"),
    "clock": (f.Time(), "time", 4, "24:00:00", "9:05:07"),
    "span": (f.Duration(), "duration", 5, "P1Y", "P1DT2H"),
    "zone": (f.TimeZoneInfo(), "time_zone", 6, "Mars/Base", "Europe/Berlin"),
    "shift": (f.TimeZone(), "time_zone", 7, "+25:00", "-0330"),
}
PATHS = {
    "dir": (f.IsDir(), "not_a_directory", 2, "/etc/passwd", "/"),
    "file": (f.IsFile(), "not_a_file", 3, "/", "/etc/passwd"),
    "path": (f.PathExists(), "not_a_path", 4, "/no/such", "/etc"),
    "link": (f.IsSymlink(), "not_a_symlink", 1, "/etc", "/etc"),
    "socket": (f.IsSocket(), "not_a_socket", 1, "/etc", "/etc"),
    "fifo": (f.IsFifo(), "not_a_fifo", 1, "/etc", "/etc"),
    "block": (f.IsBlockDevice(), "not_a_block_device", 1, "/etc", "/etc"),
}


def _bad(cases: dict) -> str:
    return counted(*[(k, code, f"page_id % {n} = 0", "pages") for k, (_, code, n, _, _) in cases.items()])


def _report(spark, sf, cases: dict):
    d = t(spark, sf, "pages").select(*[either("page_id", n, bad, good).alias(k) for k, (_, _, n, bad, good) in cases.items()])
    return Contract({k: c[0] for k, c in cases.items()}).report(d)


@query(_bad(STRINGS))
def pages_string_checks(spark, sf):
    return _report(spark, sf, STRINGS)


@query(_bad(NETWORK))
def pages_network_checks(spark, sf):
    return _report(spark, sf, NETWORK)


@query(_bad(TIMES))
def pages_time_checks(spark, sf):
    return _report(spark, sf, TIMES)


@query(_bad(PATHS))
def pages_path_checks(spark, sf):
    return _report(spark, sf, PATHS)


@query(counted(("lat", "range", "abs(c_acctbal / 50) > 90", "customer"), ("lon", "range", "abs(c_acctbal / 30) > 180", "customer"), ("byte", "range", "c_nationkey * 20 > 255", "customer"), ("small", "range", "c_acctbal / 5000 < 0 or c_acctbal / 5000 > 1", "customer"), ("below", "range", "c_acctbal >= 0", "customer"), ("share", "value", "c_acctbal < 0 or c_acctbal > 10000", "customer"), ("some", "not_true", "c_nationkey = 0", "customer"), ("none", "not_false", "c_nationkey <> 0", "customer"), ("digits", "value", "length(abs(c_acctbal::decimal(18,2))::varchar) <> 7", "customer")))
def customer_bounds(spark, sf):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    money = b.cast("decimal(18,2)").cast("string")
    d = t(spark, sf, "customer").select((b / 50).alias("lat"), (b / 30).alias("lon"), (n * 20).alias("byte"), (b / 5000).alias("small"), b.alias("below"), F.concat((b / 100).cast("decimal(18,6)").cast("string"), F.lit("%")).alias("share"), n.alias("some"), n.alias("none"), money.alias("digits"))
    return Contract({"lat": f.Latitude(), "lon": f.Longitude(), "byte": f.Byte(), "small": f.SmallFloat(), "below": f.Negative(), "share": f.Percentage(), "some": f.IsTrue(), "none": f.IsFalse(), "digits": f.Number(precision=6, scale=2)}).report(d)


@query("select p_partkey, round_even(p_retailprice, 0)::bigint as whole, round_even(p_size / 4.0, 0) * 4.0 as snapped, (p_size % 51)::double as share, p_partkey::bigint as hexed, 7::bigint as seven from part")
def part_more_numbers(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("whole"), F.col("p_size").cast("double").alias("snapped"), F.concat((F.col("p_size") % 51).cast("string"), F.lit("%")).alias("share"), F.concat(F.lit("0x"), F.lower(F.hex("p_partkey"))).alias("hexed"), F.lit(7).cast("long").alias("seven"))
    return Contract({"p_partkey": int, "whole": f.Round(), "snapped": f.Snap(4.0), "share": f.FromPercentage(), "hexed": f.HexInt(), "seven": f.Literal(7)}).apply(d).drop("errors")


@query("select event_id, date_trunc('day', ts)::date as day, epoch_us(ts)::bigint as instant, (event_id % 5000)::bigint as span, case when event_id % 2 = 0 then 12600 else -19800 end::bigint as shift, (event_id * 1000)::bigint as epoch from events")
def events_time_transforms(spark, sf):
    k, ts = F.col("event_id"), F.col("ts")
    n = k % 5000
    clock = F.format_string("%d:%02d:%02d", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)
    d = t(spark, sf, "events").select("event_id", F.date_format(ts, "yyyy-MM-dd").alias("day"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("instant"), clock.alias("span"), F.when(k % 2 == 0, "+03:30").otherwise("-0530").alias("shift"), (k * 1000).alias("epoch"))
    out = Contract({"event_id": int, "day": f.AsDate(), "instant": f.AsDatetime(require_timezone=True), "span": f.AsTimedelta(), "shift": f.AsTimezone(), "epoch": f.FromEpoch("milliseconds")}).apply(d)
    seconds = lambda c: F.expr(f"cast({c} as interval second)").cast("decimal(18,6)").cast("long").alias(c)
    return out.select("event_id", "day", F.unix_micros("instant").alias("instant"), seconds("span"), seconds("shift"), F.unix_millis("epoch").alias("epoch"))


@query("select n_name, coalesce(case when n_nationkey % 2 = 0 then n_name end, 'none') as filled, case when n_nationkey % 3 <> 0 then n_name end as full_only, 2::int as parts, 'b' as first_sorted, 3::int as kinds, 1::int as listed, n_name as bare, 'A-B' as titled, 'file' as stem, '00-11-22-AA-BB-CC' as mac from nation")
def nation_more_coercions(spark, sf):
    k, name = F.col("n_nationkey"), F.col("n_name")
    items = F.array(*map(F.lit, ["a", "b", "b", "a0"]))
    d = t(spark, sf, "nation").select("n_name", F.when(k % 2 == 0, name).alias("filled"), F.when(k % 3 == 0, "").otherwise(name).alias("full_only"), F.lit("x; ;y").alias("parts"), items.alias("first_sorted"), items.alias("kinds"), name.alias("listed"), F.concat(F.lit("\t "), name, F.lit(" \n")).alias("bare"), F.lit("a-b").alias("titled"), F.lit("file.txt").alias("stem"), F.lit("001122aabbcc").alias("mac"))
    c = Contract({"n_name": str, "filled": f.DefaultTo("none"), "full_only": f.EmptyToNone(), "parts": f.Split(";"), "first_sorted": All(f.Sort(reverse=True), f.First()), "kinds": f.Set(), "listed": f.EnsureList(), "bare": f.Strip(), "titled": f.Title(), "stem": f.RemoveSuffix(".txt"), "mac": f.NormalizeMacAddress(upper=True, separator="-")})
    out = c.apply(d)
    return out.select("n_name", "filled", "full_only", F.size("parts").alias("parts"), "first_sorted", F.size("kinds").alias("kinds"), F.size("listed").alias("listed"), "bare", "titled", "stem", "mac")


@query("select event_id, user_id from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is not null and event_type <> before")
def events_write_once(spark, sf):
    out = transitions(t(spark, sf, "events"), [r.WriteOnce("event_type")], key="user_id", order=["ts", "event_id"])
    return out.filter(F.size("errors") > 0).select("event_id", "user_id")


ORDER_DOCUMENT = {
    "type": "object",
    "required": ["o_orderkey", "o_totalprice"],
    "properties": {"o_orderkey": {"type": "integer"}, "o_totalprice": {"type": "number", "minimum": 20000, "exclusiveMaximum": 150000}, "o_orderstatus": {"enum": ["F", "O"]}, "o_orderpriority": {"type": "string", "pattern": "^[12]-", "maxLength": 8}},
    "additionalProperties": True,
}


@query("select o_orderkey from orders where o_totalprice >= 20000 and o_totalprice < 150000 and o_orderstatus in ('F','O') and o_orderpriority[2] = '-' and o_orderpriority[1] in ('1','2') and length(o_orderpriority) <= 8")
def orders_json_schema(spark, sf):
    return from_json_schema(ORDER_DOCUMENT).valid(t(spark, sf, "orders")).select("o_orderkey")


@query("select o_orderkey from orders where o_totalprice >= 20000 and o_totalprice < 150000 and o_orderstatus in ('F','O') and o_orderpriority[2] = '-' and o_orderpriority[1] in ('1','2') and length(o_orderpriority) <= 8")
def orders_json_schema_round_trip(spark, sf):
    return from_json_schema(to_json_schema(from_json_schema(ORDER_DOCUMENT))).valid(t(spark, sf, "orders")).select("o_orderkey")


@query("select p_partkey, p_name from part where p_size >= 10 and (p_partkey % 2 = 1 or p_name like '%widget')")
def part_openapi(spark, sf):
    c = from_openapi({"type": "object", "properties": {"p_partkey": {"type": "integer"}, "p_size": {"type": "integer", "minimum": 10}, "name": {"type": "string", "nullable": True, "pattern": "widget$"}}, "required": ["p_size"], "additionalProperties": True})
    d = t(spark, sf, "part").withColumn("name", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")))
    return c.valid(d).select("p_partkey", "p_name")


@dataclass
class Supplier:
    """What the query below holds suppliers against."""

    s_suppkey: int
    s_name: Annotated[str, f.StartsWith("Supplier")]
    s_nationkey: Annotated[int, f.Range(max=20)]
    kind: Literal["near", "far"] = "near"
    s_acctbal: float | None = None


@query("select s_suppkey, coalesce(case when s_suppkey % 3 = 0 then 'far' end, 'near') as kind from supplier where s_nationkey <= 20 and s_acctbal >= 0 and s_name like 'Supplier%'")
def supplier_dataclass(spark, sf):
    c = contract_of(Supplier, {"s_acctbal": Maybe(f.Range(min=0))}, extra=REMOVE_EXTRA)
    return c.valid(t(spark, sf, "supplier").withColumn("kind", F.when(F.col("s_suppkey") % 3 == 0, "far"))).select("s_suppkey", "kind")


@query(counted(("s_nationkey", "range", "s_nationkey > 10", "supplier"), ("note", "required", "true", "supplier")))
def supplier_extended(spark, sf):
    base = Contract({"s_suppkey": int, "s_nationkey": f.Range(max=3), Optional("note"): str}, extra=ALLOW_EXTRA)
    return base.extend({"s_nationkey": f.Range(max=10), Required("note"): str}).report(t(spark, sf, "supplier"))


@query("select 'o_orderstatus' as path, 'type' as code, count(*)::bigint as n from orders having count(*) > 0")
def orders_inferred(spark, sf):
    c = Contract.infer({"o_orderkey": 1, "o_totalprice": 1.5, "o_orderstatus": "F"})
    return c.report(t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("o_orderstatus")))


@query("select 0::bigint as n where (select count(*) from region) >= 0")
def region_own_schema(spark, sf):
    d = t(spark, sf, "region")
    return Contract.of_schema(d.schema).report(d).agg(F.count("*").alias("n"))


JSON_EVENTS = """(select event_id % 10 as d, json_extract(props, '$.k')::bigint as k from events)"""


@query(counted(("props.k", "range", "d not in (1, 2, 3) and k > 50", JSON_EVENTS), ("props.k", "type", "d = 1", JSON_EVENTS), ("props", "json", "d = 2", JSON_EVENTS), ("props.x", "extra_keys_not_allowed", "d = 3", JSON_EVENTS)))
def events_json_text(spark, sf):
    n = F.col("event_id") % 10
    props = F.when(n == 1, '{"k": "1"}').when(n == 2, '{"k": 1').when(n == 3, '{"k": 1, "x": 2}').otherwise(F.col("props"))
    return Contract({"props": FromJSONString({Required("k"): f.Range(max=50)}, "struct<k: bigint>")}).report(t(spark, sf, "events").select(props.alias("props")))


@query("select c_custkey, case when c_custkey % 2 = 0 then 1 else 0 end + case when c_custkey % 3 = 0 then 1 else 0 end as n from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0")
def customer_against_snapshot(spark, sf):
    key, old = F.col("c_custkey"), t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = old.withColumn("c_acctbal", F.when(key % 2 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("c_mktsegment", F.when(key % 3 != 0, F.col("c_mktsegment")))
    out = against(new, old, [r.Immutable("c_acctbal"), r.WriteOnce("c_mktsegment")], key="c_custkey")
    return out.select("c_custkey", F.size("errors").alias("n")).filter("n > 0")


@query(counted(("n", "range", "n_nationkey > 20", "nation"), ("sub[].n", "range", "n_nationkey + 1 > 20", "nation"), ("sub[].sub[].n", "range", "n_nationkey + 2 > 20", "nation")))
def nation_nested_in_itself(spark, sf):
    k = F.col("n_nationkey")
    leaf = F.array(F.struct((k + 2).alias("n")))
    d = t(spark, sf, "nation").select(k.alias("n"), F.array(F.struct((k + 1).alias("n"), leaf.alias("sub"))).alias("sub"))
    return Contract({Required("n"): f.Range(max=20), Optional("sub"): [Self]}).report(d)


@query("select event_id, strftime(ts, '%H:%M:%S.%f') as exact, ts::date as day, epoch(date_trunc('minute', ts))::bigint as minute from events")
def events_time_formats(spark, sf):
    ts = F.col("ts")
    d = t(spark, sf, "events").select("event_id", F.date_format(ts, "HH:mm:ss.SSSSSS'Z'").alias("exact"), F.date_format(ts, "d.M.yyyy").alias("day"), F.date_format(ts, "yyyy/MM/dd HH:mm").alias("minute"))
    out = Contract({"event_id": int, "exact": f.AsTime(), "day": f.AsDate("%d.%m.%Y"), "minute": f.AsDatetime("%Y/%m/%d %H:%M")}).valid(d)
    return out.withColumn("minute", F.unix_timestamp("minute"))


@dataclass
class Part:
    """A part under other names of its columns."""

    key: Annotated[int, Key(alias="p_partkey")]
    size: Annotated[int, Key(alias="p_size", secret=True), f.Range(max=25)]
    colour: Annotated[str, Key(forbidden=True)] = ""


@query("select path, key, count(*)::bigint as n from (select 'size' as path, 'secret' as key from part where p_size > 25 union all select 'colour', 'forbidden_key' from part where p_partkey % 4 = 0) group by path, key")
def part_annotated_keys(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", "p_size", F.when(F.col("p_partkey") % 4 == 0, "red").alias("colour"))
    return contract_of(Part).errors(d).groupBy("path", "key").agg(F.count("*").alias("n"))


@query("select * from (values ('o_orderkey', 'integer', true), ('o_orderstatus', 'select', false), ('o_totalprice', 'float', true)) as v(name, type, required)")
def orders_field_list(spark, sf):
    c = Contract({Required("o_orderkey"): int, "o_orderstatus": f.In(["F", "O"]), Required("o_totalprice"): All(float, f.Range(min=0))})
    return spark.createDataFrame([(x["name"], x["type"], x["required"]) for x in to_field_list(c)], "name string, type string, required boolean")


@query("select p_partkey from part where p_size >= 10 and p_size < 40")
def part_openapi_round_trip(spark, sf):
    c = Contract({"p_partkey": int, "p_size": f.Range(10, 40, max_included=False)}, extra=ALLOW_EXTRA)
    return from_openapi(to_openapi(c)).valid(t(spark, sf, "part")).select("p_partkey")
