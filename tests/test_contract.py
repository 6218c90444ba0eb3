"""Contracts by behaviour: values, codes and paths of small rows."""

import datetime
import enum

import pytest

from pactframe import ALLOW_EXTRA, REMOVE_EXTRA, Contract, SchemaError
from pactframe import functions as f
from pactframe.operators.combinators import All, Any, Maybe, Msg, SomeOf, TaggedUnion, Union
from pactframe.operators.markers import Alias, Exclusive, Extra, Forbidden, Inclusive, Optional, Remove, Required, Secret
from pactframe.operators.rules import AtLeastOne, ExactlyOne, Immutable, RequiredIf, Row, WriteOnce, transitions
from pactframe.operators.sequence import ExactSequence, Unordered


def run(spark, contract, rows, schema):
    """[(value row as a dict, [(path, code)])]."""
    out = contract.apply(spark.createDataFrame(rows, schema)).collect()
    return [({k: v for k, v in r.asDict(recursive=True).items() if k != "errors"}, [(".".join(e["path"]), e["code"]) for e in r.errors]) for r in out]


def one(spark, node, value, kind):
    """(result, codes) of one value."""
    ((row, errors),) = run(spark, Contract({"v": node}), [(value,)], f"v {kind}")
    return row.get("v"), [c for _, c in errors]


def test_keys_defaults_and_extras(spark):
    c = Contract({Required("name"): str, Optional("port", default=8080): f.Range(1, 65535)})
    got = run(spark, c, [("app", None, None), (None, 99999, "x")], "name string, port int, more string")
    assert got[0] == ({"name": "app", "port": 8080}, [])
    assert got[1][1] == [("port", "range"), ("more", "extra_keys_not_allowed"), ("name", "required")]
    assert run(spark, Contract({"a": int}, extra=ALLOW_EXTRA), [(1, "x")], "a int, b string")[0][0] == {"a": 1, "b": "x"}
    assert run(spark, Contract({"a": int}, extra=REMOVE_EXTRA), [(1, "x")], "a int, b string")[0][0] == {"a": 1}
    assert run(spark, Contract({"a": int, Extra: f.Length(max=2)}), [(1, "xyz")], "a int, b string")[0][1] == [("b", "length")]
    assert run(spark, Contract({"a": int, "missing": int}), [(1,)], "a int")[0] == ({"a": 1}, [])
    assert run(spark, Contract({"a": str}, required=True), [(None,)], "a string")[0][1] == [("a", "required")]


def test_default_is_checked_like_a_value(spark):
    assert run(spark, Contract({Optional("n", default="1"): f.Coerce(int)}), [(None,)], "n string")[0] == ({"n": 1}, [])
    assert run(spark, Contract({Optional("n", default=9): f.Range(max=5)}), [(None,)], "n int")[0][1] == [("n", "range")]


def test_markers(spark):
    c = Contract({Alias("id", "key", "nr", required=True): int, Forbidden("old"): object, Remove("note"): str, Secret(Required("pin")): f.Range(0, 9)})
    kind = "id int, key int, nr int, old string, note string, pin int"
    assert run(spark, c, [(None, 2, 3, None, "x", 4)], kind)[0] == ({"id": 2, "pin": 4}, [])
    assert run(spark, c, [(None, None, None, "y", None, 44)], kind)[0][1] == [("old", "forbidden_key"), ("pin", "range"), ("id", "required")]
    g = Contract({Exclusive("a", "ab", required=True): int, Exclusive("b", "ab"): int, Inclusive("x", "xy"): int, Inclusive("y", "xy"): int})
    kind = "a int, b int, x int, y int"
    codes = [e for _, e in run(spark, g, [(1, 2, 1, 1), (None, None, 1, None), (1, None, None, None)], kind)]
    assert codes == [[("<ab>", "exclusive")], [("<ab>", "required"), ("<xy>", "inclusive")], []]
    assert run(spark, Contract({Required(Any("a", "b")): int}), [(None, None)], "a int, b int")[0][1] == [("['a', 'b']", "required")]
    with pytest.raises(SchemaError):
        Required(Optional("a"))


def test_nested_mappings_maps_and_sequences(spark):
    c = Contract({"a": {Required("b"): f.Range(max=3), Optional("c", default="z"): str}})
    assert run(spark, c, [((9, None),)], "a struct<b:int,c:string>")[0] == ({"a": {"b": 9, "c": "z"}}, [("a.b", "range")])
    assert run(spark, Contract({"items": [f.Range(0, 5)]}), [([1, 9, None],)], "items array<int>")[0][1] == [("items.[1]", "range"), ("items.[2]", "type")]
    assert run(spark, Contract({"i": [All(f.Coerce(int), f.Range(0, 5))]}), [(["1", "x", "7"],)], "i array<string>")[0][1] == [("i.[1]", "coerce"), ("i.[2]", "range")]
    assert run(spark, Contract({"i": [Remove(f.Range(max=0)), int]}), [([1, -1, 2],)], "i array<int>")[0] == ({"i": [1, 2]}, [])
    assert run(spark, Contract({"i": []}), [([1],), ([],)], "i array<int>")[0][1] == [("i.[0]", "not_valid")]
    assert run(spark, Contract({"i": [Maybe(int)]}), [([None, 1],)], "i array<int>")[0][1] == []
    assert sorted(run(spark, Contract({"m": {f.Coerce(int): f.Range(max=2)}}), [({"1": 1, "5": 9, "x": 0},)], "m map<string,int>")[0][1]) == [("m.5", "range"), ("m.x", "coerce")]
    assert one(spark, ExactSequence([1, f.Range(2, 3)]), [1, 9], "array<int>")[1] == ["range"]
    assert one(spark, ExactSequence([1]), [1, 9], "array<int>")[1] == ["exact_sequence"]
    assert one(spark, Unordered([f.Range(min=5), f.Range(max=5)]), [1, 9], "array<int>")[1] == []
    assert one(spark, Unordered([1, 2]), [1, 1], "array<int>")[1] == ["value"]


def test_combinators(spark):
    assert one(spark, All(f.Coerce(int), f.Range(0, 10)), "5", "string") == (5, [])
    assert one(spark, All(f.Coerce(int), f.Range(0, 10)), "20", "string")[1] == ["range"]
    assert one(spark, All(f.Coerce(int), f.Range(0, 10)), "x", "string")[1] == ["coerce"]
    assert one(spark, All(f.Coerce(int), f.Range(0, 10), msg="no"), "x", "string")[1] == ["all"]
    assert one(spark, Any("a", "b"), "c", "string")[1] == ["no_match"]
    assert one(spark, Any(f.Coerce(int), f.Upper()), "c", "string") == ("C", [])
    assert one(spark, Union(f.Range(max=1), f.Range(min=5), discriminant=lambda c: (c > 3).cast("int")), 4, "int")[1] == ["range"]
    assert one(spark, SomeOf([f.Range(1, 5), int, 3], min_valid=2), 7, "int")[1] == ["not_enough_valid"]
    assert one(spark, SomeOf([f.Range(1, 5), int, 3], max_valid=2), 3, "int")[1] == ["too_many_valid"]
    assert one(spark, Msg(f.Range(max=1), "m"), 2, "int")[1] == ["value"]
    assert one(spark, Maybe(f.Range(max=1)), None, "int") == (None, [])
    tagged = TaggedUnion("type", {"grid": {"type": str, Required("stat"): int}, "solar": {"type": str, "stat": int}})
    rows = [(("wind", 1),), (("grid", None),), (("solar", None),)]
    assert [e for _, e in run(spark, Contract({"v": tagged}), rows, "v struct<type:string,stat:int>")] == [[("v.type", "value")], [("v.stat", "required")], []]


class Colour(enum.Enum):
    RED = "red"
    BLUE = "blue"


CHECKS = [
    (f.Range(1, 3), 3, "int", True), (f.Range(min=1), float("nan"), "double", False), (f.Range(0, 1, max_included=False), 1.0, "double", False), (f.Positive(), 0, "int", False), (f.Latitude(), 90.5, "double", False),
    (f.MultipleOf(3), 9, "int", True), (f.MultipleOf(3), True, "boolean", False), (f.Percentage(), "50%", "string", True), (f.Percentage(), "101", "string", False), (f.Length(min=2), "é", "string", False),
    (f.Length(max=1), [1, 2], "array<int>", False), (f.NonEmpty(), "", "string", False), (f.Contains("b"), "abc", "string", True), (f.In(["a"]), "b", "string", False), (f.NotIn(["a", None]), "b", "string", True),
    (f.Equal(1), True, "boolean", True), (Colour, "red", "string", True), (Colour, "green", "string", False), (f.Match("a.c"), "abcd", "string", True), (f.Match("b"), "ab", "string", False), (f.Alpha(), "ab\n", "string", False),
    (f.HexColor(), "#fff\n", "string", True), (f.Slug(), "a_b-c", "string", True), (f.Slug(), "-a", "string", False), (f.Email(), "a.b+c@x.org", "string", True), (f.Email(), "a..b@x.org", "string", False), (f.Email(), '"a b"@x.org', "string", False), (f.Email(), "a@x", "string", False),
    (f.Url(), "http://a b", "string", True), (f.Url(), "//x", "string", False), (f.FqdnUrl(), "http://localhost", "string", False), (f.StartsWith(("a", "b")), "bc", "string", True), (f.ByteLength(max=1), "é", "string", False),
    (f.Sorted(), [1, 1, 2], "array<int>", True), (f.Sorted(), [2, 1], "array<int>", False), (f.Unique(), [1, 1], "array<int>", False), (f.Date(), "2024-1-5", "string", True), (f.Date(), "2024-02-30", "string", False),
    (f.Datetime(), "2024-01-05T01:02:03.5Z", "string", True), (f.Time(), "25:00:00", "string", False), (f.Duration(), "P1DT2H30M", "string", True), (f.Duration(), "P", "string", False), (f.TimeZoneInfo(), "Mars/Phobos", "string", False), (f.TimeZone(), "+24:00", "string", False),
    (f.IPv4Address(), "1.2.3.04", "string", False), (f.IPv6Address(), "::1", "string", True), (f.IPv6Address(), "1::2::3", "string", False), (f.IPv6Address(), "::ffff:10.0.0.1", "string", True), (f.IPv6Address(), "1:2:3:4:5:6:7:8:9", "string", False),
    (f.IPNetwork(), "10.0.0.1/8", "string", True), (f.IPNetwork(), "10.0.0.1/33", "string", False), (f.Hostname(), "a-.b", "string", False), (f.Fqdn(), "a.b.", "string", True), (f.Port(), "0", "string", False), (f.UUID(version=4), "{12345678-1234-4234-8234-123456789abc}", "string", True),
    (f.UUID(version=1), "12345678-1234-4234-8234-123456789abc", "string", False), (f.ULID(), "01ARZ3NDEKTSV4RRFFQ69G5FAV", "string", True), (f.MacAddress(), "00:11-22:33:44:55", "string", False), (f.Base64(), "YQ", "string", False), (f.Base64(), "YQ==", "string", True), (f.Hex(), "0a b", "string", False),
    (f.CreditCard(), "4111 1111 1111 1111", "string", True), (f.CreditCard(), "4111111111111112", "string", False), (f.IBAN(), "GB82 WEST 1234 5698 7654 32", "string", True), (f.DataURI(), "data:text/plain;base64,YQ==", "string", True), (f.DataURI(), "x:,", "string", False),
    (f.E164(), "+4912345", "string", True), (f.E164(), "04912345", "string", False), (f.JSONString(), '{"a":1}', "string", True), (f.JSONString(), "{", "string", False), (f.IsTrue(), 0, "int", False), (f.IsFalse(), "", "string", True), (f.Number(precision=4, scale=2), "12.34", "string", True), (f.Number(precision=3, scale=2), "12.34", "string", False),
    (str, 1, "int", False), (int, True, "boolean", True), (bool, 1, "int", False), (f.Positive(), "x", "string", False),
]


@pytest.mark.parametrize("node,value,kind,ok", CHECKS, ids=[f"{i}-{c[1]!r}" for i, c in enumerate(CHECKS)])
def test_checks(spark, node, value, kind, ok):
    got, codes = one(spark, node, value, kind)
    assert (codes == []) == ok


TRANSFORMS = [
    (f.Clamp(0, 5), 9, "int", 5), (f.Multiply(3), 4, "int", 12), (f.Divide(4), 2, "int", 0.5), (f.Offset(-1), 1, "int", 0), (f.Round(), 2.5, "double", 2), (f.Scale(9, divisor=5, offset=32), 100, "int", 212.0), (f.Remap(0, 10, 0, 100), 5, "int", 50.0), (f.Snap(5), 12, "int", 10.0),
    (f.RoundUp(), 1.2, "double", 2), (f.RoundDown(), -1.2, "double", -2), (f.Abs(), -(2**31), "int", 2**31), (f.Modulo(-3), 10, "int", -2), (f.FromPercentage(), "12.5%", "string", 12.5), (f.Coerce(int), " 1_000 ", "string", 1000), (f.Coerce(int), 1.9, "double", 1), (f.Coerce(float), "1e3", "string", 1000.0),
    (f.Coerce(str), True, "boolean", "True"), (f.Boolean(), "Enable", "string", True), (f.SetTo(5), "x", "string", 5), (f.DefaultTo(7), None, "int", 7), (f.Map({1: "a"}), 1, "int", "a"), (f.Map({1: "a"}, default=f.PASSTHROUGH), 2, "int", "2"), (f.EmptyToNone(), "", "string", None), (float, 5, "int", 5.0),
    (f.Replace(r"(\w)-(?P<x>\w)", r"\2\g<x>$"), "a-b", "string", "bb$"), (f.Lower(), "É", "string", "é"), (f.Capitalize(), "aBC", "string", "Abc"), (f.Title(), "they're a-b", "string", "They'Re A-B"), (f.Strip(), "\t a \n", "string", "a"), (f.CollapseWhitespace(), " a \n b", "string", "a b"), (f.RemovePrefix("a"), "ab", "string", "b"),
    (f.RemoveSuffix("b"), "ab", "string", "a"), (f.Truncate(2), "\U0001f600ab", "string", "\U0001f600a"), (f.Sort(reverse=True), [1, 3, 2], "array<int>", [3, 2, 1]), (f.Dedupe(), [2, 1, 2], "array<int>", [2, 1]), (f.First(), [4, 5], "array<int>", 4), (f.Last(), [4, 5], "array<int>", 5), (f.Without([1]), [1, 2, 2], "array<int>", [2, 2]),
    (f.Split("|"), " a | |b", "string", ["a", "b"]), (f.Join("-"), [1, None], "array<int>", "1-None"), (f.EnsureList(), "x", "string", ["x"]), (f.AsDate(), "20240105", "string", datetime.date(2024, 1, 5)), (f.AsTimedelta(), "-0:30", "string", datetime.timedelta(minutes=-30)), (f.AsTimedelta(), "PT45S", "string", datetime.timedelta(seconds=45)),
    (f.AsTimezone(), "-05:30", "string", -datetime.timedelta(hours=5, minutes=30)), (f.HexInt(), "0x1A", "string", 26), (f.Port(), 443.0, "double", 443), (f.NormalizeMacAddress(upper=True), "001122aabbcc", "string", "00:11:22:AA:BB:CC"), (f.In(["a b"], fold_case=True, space=True), " A  b", "string", "a b"), (f.E164(normalize=True), "+49 (12) 34-5", "string", "+4912345"),
]


@pytest.mark.parametrize("node,value,kind,want", TRANSFORMS, ids=[f"{i}-{c[1]!r}" for i, c in enumerate(TRANSFORMS)])
def test_transforms(spark, node, value, kind, want):
    if value is None:
        out = Contract({"v": node}).apply(spark.createDataFrame([(value,)], f"v {kind}")).first()
        assert out.v == want
    else:
        assert one(spark, node, value, kind) == (want, [])


def test_overflow_and_hostile_values_are_errors_of_the_row(spark):
    assert one(spark, f.Multiply(10), 2**62, "bigint")[1] == ["value"]
    assert one(spark, f.RoundUp(), float("inf"), "double")[1] == ["value"]
    assert one(spark, f.Coerce(int), "9" * 40, "string")[1] == ["coerce"]
    assert one(spark, f.FromEpoch(), float("nan"), "double")[1] == ["epoch"]
    assert one(spark, f.First(), [], "array<int>")[1] == ["value"]


def test_bad_contracts_fail_when_made():
    for make in (lambda: f.MultipleOf(0), lambda: f.Divide(0), lambda: f.Match("("), lambda: f.Range(1, 2, 3, 4, 5), lambda: SomeOf([int]), lambda: Contract([1]), lambda: f.FromEpoch("days")):
        with pytest.raises(SchemaError):
            make()


def test_rules_and_transitions(spark):
    c = Contract({"a": int, "b": int}, rules=[AtLeastOne("a", "b"), ExactlyOne("a", "b"), RequiredIf({"a": 1}, "b"), Row(lambda c: c("a") < 5)])
    rows = [(1, None), (None, None), (1, 2)]
    assert [[e for e in errors] for _, errors in run(spark, c, rows, "a int, b int")] == [[("b", "required")], [("", "required"), ("", "required"), ("", "value")], [("a", "exclusive"), ("b", "exclusive")]]
    df = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", None), (2, 1, None, None), (2, 2, "c", "y")], "k int, t int, i string, w string")
    out = transitions(df, [Immutable("i"), WriteOnce("w")], key="k", order=["t"]).orderBy("k", "t").collect()
    assert [[e["path"][0] for e in r.errors] for r in out] == [[], ["i", "w"], [], []]


def test_report_valid_invalid_and_extend(spark):
    df = spark.createDataFrame([(1, [1, 9]), (9, [9, 9]), (2, [1])], "a int, i array<int>")
    c = Contract({"a": f.Range(max=5)}).extend({"i": [f.Range(max=5)]})
    assert sorted(map(tuple, c.report(df).collect())) == [("a", "range", 1), ("i[]", "range", 3)]
    assert c.valid(df).count() == 1 and c.invalid(df).count() == 2 and c.errors(df, keep=["a"]).count() == 4
    assert c.apply(df.limit(0)).count() == 0
    assert Contract({"a": int}) == Contract({"a": int})
    assert Contract.infer({"a": 1, "b": ["x"]}) == Contract({Required("a"): int, Required("b"): [str]})
    assert run(spark, Contract.of_schema(df.schema), [(1, [2])], "a int, i array<int>")[0][1] == []


def test_plans_have_no_python_and_push_filters(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as int) a", "cast(id as string) b", "id c").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = Contract({"a": f.Range(2, 5)}, extra=REMOVE_EXTRA).valid(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema: struct<a:int>" in plan
