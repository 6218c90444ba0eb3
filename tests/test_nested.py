"""Contracts that nest in themselves, keys by annotation, field lists, snapshots, formats of times."""

import dataclasses
import enum
import json
import typing

import pytest

from pactframe import Contract, SchemaError, Self
from pactframe import functions as f
from pactframe.codecs import Key, contract_of, from_json_schema, to_field_list, to_json_schema
from pactframe.codecs.fields import UNSUPPORTED
from pactframe.operators.combinators import All, Any, Maybe
from pactframe.operators.markers import Forbidden, Optional, Required, Secret
from pactframe.operators.parsed import FromJSONString
from pactframe.operators.rules import Immutable, WriteOnce, against

TREE = "n int, sub array<struct<n:int,sub:array<struct<n:int>>>>"


def errors(spark, contract, rows, kind):
    return [sorted((".".join(e["path"]), e["code"]) for e in r.errors) for r in contract.apply(spark.createDataFrame(rows, kind)).collect()]


def test_self(spark):
    rows = [(1, [(2, [(9,), (3,)]), (8, None)]), (None, [(None, [])]), (1, None)]
    want = [[("sub.[0].sub.[0].n", "range"), ("sub.[1].n", "range")], [("n", "required"), ("sub.[0].n", "required")], []]
    assert errors(spark, Contract({Required("n"): f.Range(max=5), Optional("sub"): [Self]}), rows, TREE) == want
    doc = {"type": "object", "required": ["n"], "properties": {"n": {"$ref": "#/$defs/small"}, "sub": {"type": "array", "items": {"$ref": "#"}}}, "$defs": {"small": {"type": "integer", "maximum": 5}}}
    made = from_json_schema(doc)
    assert errors(spark, made, rows, TREE) == want
    assert '"items": {"$ref": "#"}' in json.dumps(to_json_schema(made))
    # a contract inside another stands for itself
    inner = Contract({"n": f.Range(max=5), "sub": [Self]})
    assert errors(spark, Contract({"a": inner, "b": int}), [((1, [(9, None)]), 1)], f"a struct<{TREE.replace(' ', ':', 1).replace(', sub ', ', sub:')}>, b int") == [[("a.sub.[0].n", "range")]]


@pytest.mark.parametrize("ref", ["#/$defs/none", "other.json", "#/$defs/loop"])
def test_bad_references(ref):
    with pytest.raises(SchemaError):
        from_json_schema({"type": "object", "properties": {"a": {"$ref": ref}}, "$defs": {"loop": {"type": "array", "items": {"$ref": "#/$defs/loop"}}}})


@dataclasses.dataclass
class Tree:
    n: typing.Annotated[int, f.Range(max=5)]
    sub: typing.Optional[list["Tree"]] = None


@dataclasses.dataclass
class Keyed:
    a: typing.Annotated[int, Key(alias="old")]
    b: typing.Annotated[str, Key(forbidden=True)] = ""
    c: typing.Annotated[int, f.Range(max=5), Key(secret=True, required=True)] = 1
    d: typing.Annotated[str, Key(inclusive="g")] = ""
    e: typing.Annotated[str, Key(inclusive="g")] = ""


def test_annotated_keys(spark):
    assert errors(spark, contract_of(Tree), [(1, [(9, None)])], TREE) == [[("sub.[0].n", "range")]]
    df = spark.createDataFrame([(1, "x", 9), (2, None, None)], "old int, b string, c int")
    got = contract_of(Keyed).apply(df).collect()
    assert [r.a for r in got] == [1, 2]
    assert [{(e["code"], e["key"]) for e in r.errors} for r in got] == [{("forbidden_key", "forbidden_key"), ("range", "secret")}, {("required", "required")}]
    with pytest.raises(SchemaError):
        contract_of(dataclasses.make_dataclass("Two", [("a", typing.Annotated[int, Key(forbidden=True, alias="x")])]))


class Mode(enum.Enum):
    ON, OFF = "on", "off"


def test_field_list():
    c = Contract({Required("a", description="d"): All(f.Coerce(int), f.Range(1, 9)), Optional("m", default="on"): Mode, Secret(Required("s")): All(str, f.Lower(), f.Length(min=3)), "x": Maybe(f.Email()), "c": Any("u", "v"), "l": [f.IPv4Address()], Forbidden("z"): int, "n": {"p": f.Port()}})
    rows = {r["name"]: r for r in to_field_list(c)}
    assert list(rows) == ["a", "m", "s", "x", "c", "l", "n"]
    assert rows["a"] == {"type": "integer", "valueMin": 1, "valueMax": 9, "name": "a", "required": True, "description": "d"}
    assert rows["m"] == {"type": "select", "options": [("on", "on"), ("off", "off")], "name": "m", "required": False, "optional": True, "default": "on"}
    assert rows["s"] == {"type": "string", "lower": True, "lengthMin": 3, "name": "s", "required": True, "secret": True}
    assert rows["x"]["format"] == "email" and rows["x"]["allow_none"] and rows["c"]["options"] == [("u", "u"), ("v", "v")]
    assert rows["l"]["type"] == "string" and rows["n"]["schema"][0]["valueMax"] == 65535
    assert to_field_list(str) == {"type": "string"}
    with pytest.raises(ValueError, match="no field"):
        to_field_list(f.Sorted())
    assert to_field_list(f.Sorted(), custom=lambda n: {"type": "own"}) == {"type": "own"}
    assert to_field_list(int, custom=lambda n: UNSUPPORTED) == {"type": "integer"}


def test_against(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (None, "c", "y")], "k int, v string, w string")
    new = spark.createDataFrame([(1, "b", None), (1, "a", "x"), (2, None, "z"), (3, "q", "q"), (None, "d", "d")], "k int, v string, w string")
    out = against(new, old, [Immutable("v"), WriteOnce("w")], key="k").collect()
    got = {(r.k, r.v): [(e["path"][0], e["code"]) for e in r.errors] for r in out}
    assert len(out) == 5 and got == {(1, "b"): [("v", "immutable"), ("w", "immutable")], (1, "a"): [], (2, None): [], (3, "q"): [], (None, "d"): []}
    assert against(new.limit(0), old, [Immutable("v")], key="k").count() == 0


def test_formats_of_times(spark):
    c = Contract({"t": f.Time("%I:%M %p"), "d": f.AsDate("%d.%m.%Y"), "s": f.AsDatetime("%Y/%m/%d %H:%M"), "i": f.AsTime()})
    df = spark.createDataFrame([("9:05 AM", "1.2.2024", "2024/1/2 3:04", "09:05"), ("13:05 AM", "30.2.2024", "2024/13/1 0:00", "24:00"), (None, None, None, "090507,25+02:00"), (None, None, None, "")], "t string, d string, s string, i string")
    rows = c.apply(df).collect()
    assert [str(rows[0].d), str(rows[0].s), rows[0].i, rows[2].i] == ["2024-02-01", "2024-01-02 03:04:00", "09:05:00.000000", "09:05:07.250000"]
    assert [sorted(e["code"] for e in r.errors) for r in rows] == [[], ["date", "datetime", "time", "time"], [], ["time"]]
    with pytest.raises(SchemaError):
        f.Time("%Q")


def test_json_text(spark):
    rows = ['{"a": 1, "b": {"c": "x"}, "l": [1, 2.5]}', '{"a": "1", "b": {"c": 2, "d": 1}, "z": 0}', "{a", '{"a": 9, "l": ["u", 1]}', None, "[1]", '{"a": 5.0}', '{"a": true}', '{"a": null, "b": null}', '{"a": 1, "a": 2}']
    inner = {Required("a"): f.Range(max=5), "b": {"c": str}, "l": [float]}
    kind = "struct<a: int, b: struct<c: string>, l: array<double>>"
    df = spark.createDataFrame([(x,) for x in rows], "j string")
    got = Contract({"j": FromJSONString(inner, kind)}).apply(df).collect()
    want = [[], [("j.a", "type"), ("j.b.c", "type"), ("j.b.d", "extra_keys_not_allowed"), ("j.z", "extra_keys_not_allowed")], [("j", "json")], [("j.l", "type")], [], [("j", "type")], [("j.a", "type")], [("j.a", "type")], [("j.a", "required")], [("j", "json")]]
    assert [sorted((".".join(e["path"]), e["code"]) for e in r.errors) for r in got] == want
    assert got[0].j.b.c == "x" and got[0].j.l == [1.0, 2.5]
    assert Contract({"j": FromJSONString(inner, kind, keep=True)}).valid(df).filter("j is not null").first().j == rows[0]
    with pytest.raises(SchemaError):
        FromJSONString(int, "int")
