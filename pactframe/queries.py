"""Registered queries over the tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactframe import ALLOW_EXTRA, REMOVE_EXTRA, Contract, function_queries
from pactframe import functions as f
from pactframe.operators import rules as r
from pactframe.operators.combinators import All, Any, Maybe, Msg, SomeOf, TaggedUnion, Union
from pactframe.operators.markers import Alias, Exclusive, Extra, Forbidden, Inclusive, Optional, Remove, Required, Secret
from pactframe.operators.rules import transitions
from pactframe.operators.sequence import ExactSequence, Unordered
from pactframe.registry import QUERIES, SQL, counted, either, query, t

__all__ = ["QUERIES", "SQL", "function_queries"]

CUSTOMER = {Required("c_custkey"): All(int, f.Positive()), Required("c_name"): f.Match(r"Customer#\d{9}"), Required("c_nationkey"): f.Range(0, 20), Required("c_acctbal"): f.Range(min=0), Required("c_mktsegment"): f.In(["BUILDING", "MACHINERY"])}


@query(counted(("c_custkey", "range", "c_custkey <= 0", "customer"), ("c_nationkey", "range", "c_nationkey > 20", "customer"), ("c_acctbal", "range", "c_acctbal < 0", "customer"), ("c_mktsegment", "not_in_list", "c_mktsegment not in ('BUILDING','MACHINERY')", "customer")))
def customer_contract_report(spark, sf):
    return Contract(CUSTOMER).report(t(spark, sf, "customer"))


@query("select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey > 0 and c_nationkey <= 20 and c_acctbal >= 0 and c_mktsegment in ('BUILDING','MACHINERY')")
def customer_valid_rows(spark, sf):
    return Contract(CUSTOMER).valid(t(spark, sf, "customer"))


@query("select c_custkey, (c_custkey <= 0)::int + (c_nationkey > 20)::int + (c_acctbal < 0)::int + (c_mktsegment not in ('BUILDING','MACHINERY'))::int as n_errors from customer where c_custkey <= 0 or c_nationkey > 20 or c_acctbal < 0 or c_mktsegment not in ('BUILDING','MACHINERY')")
def customer_invalid_rows(spark, sf):
    return Contract(CUSTOMER).invalid(t(spark, sf, "customer")).select("c_custkey", F.size("errors").alias("n_errors"))


@query(counted(("l_quantity", "range", "l_quantity < 5 or l_quantity > 45", "lineitem"), ("l_discount", "range", "l_discount >= 0.08", "lineitem"), ("l_returnflag", "in_list", "l_returnflag = 'A'", "lineitem"), ("l_linenumber", "range", "l_linenumber <= 1", "lineitem")))
def lineitem_range_report(spark, sf):
    c = Contract({"l_quantity": f.Range(5, 45), "l_discount": f.Range(max=0.08, max_included=False), "l_returnflag": f.NotIn(["A"]), "l_linenumber": f.Range(1, None, min_included=False)}, extra=ALLOW_EXTRA)
    return c.report(t(spark, sf, "lineitem"))


@query(counted(("p_size", "multiple_of", "p_size % 5 <> 0", "part"), ("p_brand", "value", "p_brand <> 'Brand#1'", "part"), ("p_type", "length", "length(p_type) > 8", "part"), ("p_name", "contains", "not contains(p_name, '1')", "part")))
def part_multiple_of(spark, sf):
    c = Contract({"p_size": f.MultipleOf(5), "p_brand": f.Equal("Brand#1"), "p_type": f.Length(min=1, max=8), "p_name": f.Contains("1")}, extra=REMOVE_EXTRA)
    return c.report(t(spark, sf, "part"))


@query("select l_orderkey, l_linenumber, l_discount * 100.0 / 4.0 + 1.0 as l_discount, greatest(10.0, least(40.0, l_quantity)) as l_quantity, l_extendedprice * 2.0 as l_extendedprice, l_tax - 1.0 as l_tax, ceil(l_quantity / 7.0)::bigint as boxes from (select *, l_quantity as q from lineitem)")
def lineitem_scale_discount(spark, sf):
    c = Contract({"l_orderkey": int, "l_linenumber": int, "l_discount": f.Scale(100, divisor=4, offset=1), "l_quantity": f.Clamp(10.0, 40.0), "l_extendedprice": f.Multiply(2.0), "l_tax": f.Offset(-1.0), "boxes": All(f.Divide(7), f.RoundUp())}, extra=REMOVE_EXTRA)
    return c.apply(t(spark, sf, "lineitem").withColumn("boxes", F.col("l_quantity"))).drop("errors")


@query("select p_partkey, ((p_size % -7) - 7) % -7 as modulo, abs(p_size - 25)::bigint as distance, (p_size - 1.0) * 100.0 / 49.0 + 0.0 as remapped, floor(p_retailprice)::bigint as low from part")
def part_number_transforms(spark, sf):
    d = t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("modulo"), F.col("p_size").alias("distance"), F.col("p_size").alias("remapped"), F.col("p_retailprice").alias("low"))
    return Contract({"p_partkey": int, "modulo": f.Modulo(-7), "distance": All(f.Offset(-25), f.Abs()), "remapped": f.Remap(1, 50, 0, 100), "low": f.RoundDown()}).apply(d).drop("errors")


@query(counted(("o_orderstatus", "no_match", "o_orderstatus not in ('F','O')", "orders"), ("o_totalprice", "range", "not (o_totalprice < 1000 or o_totalprice > 100000)", "orders")))
def orders_any_status(spark, sf):
    c = Contract({"o_orderstatus": Any("F", "O"), "o_totalprice": Any(f.Range(max=1000, max_included=False), f.Range(min=100000, min_included=False))}, extra=ALLOW_EXTRA)
    return c.report(t(spark, sf, "orders"))


@query("select code, count(*)::bigint as n from (select (o_totalprice >= 50000)::int + (o_totalprice <= 150000)::int + (o_totalprice >= 100000)::int as k, case when k < 2 then 'not_enough_valid' when k > 2 then 'too_many_valid' end as code from orders) where code is not null group by code")
def orders_some_of(spark, sf):
    c = Contract({"o_totalprice": SomeOf([f.Range(min=50000), f.Range(max=150000), f.Range(min=100000)], min_valid=2, max_valid=2)}, extra=ALLOW_EXTRA)
    return c.report(t(spark, sf, "orders")).select("code", "n")


@query("select c_custkey, coalesce(case when c_mktsegment <> 'BUILDING' then c_mktsegment end, 'none') as segment, case when c_acctbal >= 0 then c_acctbal end as balance, (c_acctbal < 0) as failed from customer")
def customer_required_default(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    out = Contract({Required("c_custkey"): int, Optional("segment", default="none"): f.NonEmpty(), Required("balance"): float}).apply(d)
    return out.select("c_custkey", "segment", "balance", (F.size("errors") > 0).alias("failed"))


GROUPED = "(select case when o_orderkey % 2 = 0 then 1 end as a, case when o_orderkey % 3 = 0 then 1 end as b, case when o_orderkey % 5 = 0 then 1 end as x, case when o_orderkey % 7 = 0 then 1 end as y, case when o_orderkey % 11 = 0 then 1 end as z from orders)"


def _grouped(spark, sf):
    key = F.col("o_orderkey")
    return t(spark, sf, "orders").select(*[F.when(key % n == 0, F.lit(1)).alias(k) for k, n in (("a", 2), ("b", 3), ("x", 5), ("y", 7), ("z", 11))])


@query(counted(("<one>", "exclusive", "a is not null and b is not null", GROUPED), ("<one>", "required", "a is null and b is null", GROUPED), ("<pair>", "inclusive", "(x is null) <> (y is null)", GROUPED), ("z", "forbidden_key", "z is not null", GROUPED)))
def orders_exclusive_group(spark, sf):
    c = Contract({Exclusive("a", "one", required=True): int, Exclusive("b", "one"): int, Inclusive("x", "pair"): int, Inclusive("y", "pair"): int, Forbidden("z"): int})
    return c.report(_grouped(spark, sf))


@query(counted(("b", "required", "a is not null and b is null", GROUPED), ("y", "required", "x is null and y is null", GROUPED), ("z", "required", "coalesce(a = 1, false) and z is null", GROUPED), ("", "required", "x is null and y is null and z is null", GROUPED), *[(k, "exclusive", f"{k} is not null and (x is not null)::int + (y is not null)::int > 1", GROUPED) for k in "xy"], *[(k, "inclusive", f"{k} is null and not (a is null and b is null)", GROUPED) for k in "ab"], ("", "value", "not coalesce(a + b = 2, false)", GROUPED)))
def orders_cross_field(spark, sf):
    c = Contract({}, extra=ALLOW_EXTRA, rules=[r.RequiredWith("a", "b"), r.RequiredWithout("x", "y"), r.RequiredIf({"a": 1}, "z"), r.AtLeastOne("x", "y", "z"), r.AtMostOne("x", "y"), r.AllOrNone("a", "b"), r.Row(lambda c: c("a") + c("b") == 2)])
    return c.report(_grouped(spark, sf))


@query("select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_orderstatus end, o_orderpriority) as status from orders")
def orders_alias(spark, sf):
    d = t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("st"), F.col("o_orderpriority").alias("prio"))
    return Contract({"o_orderkey": int, Alias("status", "st", "prio", required=True): str}).apply(d).drop("errors")


@query(counted(("c_mktsegment", "extra_keys_not_allowed", "true", "customer"), ("c_acctbal", "extra_keys_not_allowed", "c_acctbal < 0", "customer"), ("c_nationkey", "extra_keys_not_allowed", "true", "customer")))
def customer_extra_keys(spark, sf):
    return Contract({"c_custkey": int, "c_name": str, Remove("c_acctbal"): f.NonNegative()}).report(t(spark, sf, "customer"))


@query("select code, key, count(*)::bigint as n from (select 'range' as code, 'secret' as key from customer where c_acctbal < 0 union all select 'extra', 'x' from customer where false) group by code, key")
def customer_secret(spark, sf):
    c = Contract({Secret(Required("c_acctbal")): f.NonNegative(), Extra: object})
    return c.errors(t(spark, sf, "customer")).groupBy("code", "key").agg(F.count("*").alias("n"))


ITEMS = "(select o_orderkey, list_sort(list(l_quantity::bigint)) as q from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey)"


def _items(spark, sf):
    line = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    return t(spark, sf, "orders").select("o_orderkey").join(line, "o_orderkey")


@query(f"select o_orderkey, '[' || (i - 1)::varchar || ']' as at, 'range' as code from (select o_orderkey, unnest(q) as v, generate_subscripts(q, 1) as i from {ITEMS}) where v > 45")
def order_items_sequence(spark, sf):
    c = Contract({"o_orderkey": int, "q": [f.Range(max=45)]})
    return c.errors(_items(spark, sf), keep=["o_orderkey"]).select("o_orderkey", F.element_at(F.split("path", r"\."), -1).alias("at"), "code")


@query(f"select o_orderkey, len(list_distinct(q))::int as kinds, q[1] as lowest, q[-1] as highest, len(list_filter(q, lambda x: x <> 1))::int as not_one, array_to_string(q, '-') as joined, len(q) <> len(list_distinct(q)) as repeats from {ITEMS}")
def order_items_arrays(spark, sf):
    d = _items(spark, sf).select("o_orderkey", *[F.col("q").alias(x) for x in ("kinds", "lowest", "highest", "not_one", "joined", "repeats")])
    c = Contract({"o_orderkey": int, "kinds": f.Dedupe(), "lowest": f.First(), "highest": f.Last(), "not_one": f.Without([1]), "joined": f.Join("-"), "repeats": All(f.Sorted(), f.Unique())})
    return c.apply(d).select("o_orderkey", F.size("kinds").alias("kinds"), "lowest", "highest", F.size("not_one").alias("not_one"), "joined", (F.size("errors") > 0).alias("repeats"))


@query("select ok, exact, count(*)::bigint as n from (select o_orderkey % 3 = 0 as ok, o_orderkey % 4 = 0 as exact from orders) group by ok, exact")
def orders_unordered_and_exact(spark, sf):
    key = F.col("o_orderkey")
    d = t(spark, sf, "orders").select(F.when(key % 3 == 0, F.array(F.lit(7), F.lit(200))).otherwise(F.array(F.lit(7), F.lit(8))).alias("u"), F.when(key % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1))).alias("e"))
    out = Contract({"u": Unordered([f.Range(min=100), f.Range(max=100)]), "e": ExactSequence([1, f.Range(2, 5)])}).apply(d)
    has = lambda k: ~F.exists("errors", lambda e: e["path"][0] == k)
    return out.select(has("u").alias("ok"), has("e").alias("exact")).groupBy("ok", "exact").agg(F.count("*").alias("n"))


@query("select event_type, count(*)::bigint as n from (select event_type, case when event_type in ('click','view') then value > 100 when event_type = 'purchase' then value < 10 else true end as bad from events) where bad group by event_type")
def events_tagged_union(spark, sf):
    d = t(spark, sf, "events").select("event_type", F.struct("event_type", "value").alias("e"))
    low, high = {"event_type": str, "value": f.Range(max=100)}, {"event_type": str, "value": f.Range(min=10)}
    c = Contract({"event_type": str, "e": TaggedUnion("event_type", {"click": low, "view": low, "purchase": high})})
    return c.errors(d, keep=["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select event_id, regexp_extract(props, '(\\d+)', 1)::bigint as k, floor(value)::bigint as whole, event_type in ('click','view') as seen from events")
def events_coerce(spark, sf):
    d = t(spark, sf, "events").select("event_id", F.regexp_extract("props", r"(\d+)", 1).alias("k"), F.floor("value").cast("double").alias("whole"), F.when(F.col("event_type").isin("click", "view"), "Yes").otherwise("off").alias("seen"))
    return Contract({"event_id": int, "k": f.Coerce(int), "whole": f.Coerce(int), "seen": f.Boolean()}).apply(d).drop("errors")


@query("select event_id, user_id, value from (select *, lag(value) over (partition by user_id order by ts, event_id) as before from events) where before is not null and value <> before")
def events_immutable(spark, sf):
    out = transitions(t(spark, sf, "events"), [r.Immutable("value")], key="user_id", order=["ts", "event_id"])
    return out.filter(F.size("errors") > 0).select("event_id", "user_id", "value")


@query("select c_custkey, upper(c_mktsegment) as up, lower(c_mktsegment) as low, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) as cap, left(c_name, 10) as cut, substr(c_name, 10) as tail, regexp_replace(c_name, '0+', '-', 'g') as dashed, 'a b' as collapsed from customer")
def customer_string_transforms(spark, sf):
    d = t(spark, sf, "customer").select("c_custkey", *[F.col("c_mktsegment").alias(x) for x in ("up", "low", "cap")], *[F.col("c_name").alias(x) for x in ("cut", "tail", "dashed")], F.lit(" a \t b ").alias("collapsed"))
    c = Contract({"c_custkey": int, "up": f.Upper(), "low": f.Lower(), "cap": f.Capitalize(), "cut": f.Truncate(10), "tail": f.RemovePrefix("Customer#"), "dashed": f.Replace("0+", "-"), "collapsed": f.CollapseWhitespace()})
    return c.apply(d).drop("errors")


@query(counted(("email", "email", "page_id % 3 = 0", "pages"), ("ip", "ip", "page_id % 5 = 0", "pages"), ("url", "url", "url is not null and not regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+')", "pages"), ("slug", "slug", "page_id % 7 = 0", "pages"), ("uuid", "uuid", "page_id % 2 = 0", "pages"), ("day", "date", "page_id % 4 = 0", "pages"), ("card", "credit_card", "page_id % 6 = 0", "pages"), ("iban", "iban", "page_id % 9 = 0", "pages"), ("port", "range", "page_id % 8 = 0", "pages")))
def pages_formats(spark, sf):
    d = t(spark, sf, "pages").select("url", either("page_id", 3, "a..b@x.org", "a.b@x.org").alias("email"), either("page_id", 5, "256.1.1.1", "10.0.0.1").alias("ip"), either("page_id", 7, "-a", "a-b").alias("slug"), either("page_id", 2, "123", "12345678-1234-4234-8234-123456789abc").alias("uuid"), either("page_id", 4, "2024-02-30", "2024-2-9").alias("day"), either("page_id", 6, "4111111111111112", "4111 1111 1111 1111").alias("card"), either("page_id", 9, "GB82WEST12345698765431", "GB82 WEST 1234 5698 7654 32").alias("iban"), either("page_id", 8, "70000", "443").alias("port"))
    return Contract({"url": f.Url(), "email": f.Email(), "ip": f.IPAddress(), "slug": f.Slug(), "uuid": f.UUID(version=4), "day": f.Date(), "card": f.CreditCard(), "iban": f.IBAN(), "port": f.Port()}).report(d)


@query(counted(("o_orderpriority", "all", "o_orderpriority not in ('1-URGENT','2-HIGH') or length(o_orderpriority) > 7", "orders"), ("o_custkey", "value", "o_custkey % 2 <> 0", "orders")))
def orders_all_and_msg(spark, sf):
    c = Contract({"o_orderpriority": All(f.In(["1-URGENT", "2-HIGH"]), f.Length(max=7), msg="urgent only"), "o_custkey": Msg(f.MultipleOf(2), "even only"), "o_orderstatus": Maybe(Union("F", "O", "P"))}, extra=ALLOW_EXTRA)
    return c.report(t(spark, sf, "orders"))


@query("select n_name, case n_regionkey when 0 then 'south' when 1 then 'west' else 'other' end as n_regionkey, true as fixed from nation")
def nation_map(spark, sf):
    c = Contract({"n_name": str, "n_regionkey": f.Map({0: "south", 1: "west"}, default="other"), "fixed": f.SetTo(True)}, extra=REMOVE_EXTRA)
    return c.apply(t(spark, sf, "nation").withColumn("fixed", F.lit(False))).drop("errors")
