import dataclasses
import typing

import pytest

from pactframe import ALLOW_EXTRA, Contract, SchemaError
from pactframe import functions as f
from pactframe.codecs import contract_of, from_json_schema, from_openapi, to_json_schema, to_openapi
from pactframe.codecs.jsonschema import is_catastrophic
from pactframe.operators.combinators import All, Any, Maybe
from pactframe.operators.markers import Exclusive, Forbidden, Inclusive, Optional, Required, Secret


def errors(spark, contract, rows, kind):
    return [sorted((".".join(e["path"]), e["code"]) for e in r.errors) for r in contract.apply(spark.createDataFrame(rows, kind)).collect()]


def test_encode():
    c = Contract({Required("a", description="d"): All(f.Coerce(int), f.Range(1, 9, max_included=False)), Optional("b", default="x"): Any("x", "y"), Secret("s"): f.Email(), Optional("m"): Maybe(str), Optional("l"): [f.Range(max=1)], Forbidden("z"): object, Inclusive("p", "g"): int, Inclusive("q", "g"): int, Exclusive("u", "h"): int, Exclusive("v", "h"): int})
    doc = to_json_schema(c)
    assert doc["required"] == ["a"] and doc["additionalProperties"] is False
    assert doc["properties"]["a"] == {"type": "integer", "minimum": 1, "exclusiveMaximum": 9, "description": "d"}
    assert doc["properties"]["b"] == {"enum": ["x", "y"], "default": "x"} and doc["properties"]["s"] == {"type": "string", "format": "email", "writeOnly": True}
    assert doc["properties"]["z"] is False and doc["dependentRequired"] == {"p": ["q"], "q": ["p"]} and doc["allOf"] == [{"not": {"required": ["u", "v"]}}]
    assert to_openapi(c, "3.0.3")["properties"]["m"] == {"type": "string", "nullable": True}
    assert to_openapi(c, "3.0.3")["properties"]["a"]["exclusiveMaximum"] is True
    with pytest.raises(SchemaError):
        to_json_schema(Contract({"a": f.Sorted()}), strict=True)
    assert to_json_schema(Contract({"a": f.Match("b+")}, extra=ALLOW_EXTRA))["properties"]["a"] == {"pattern": "^(?:b+)"}


def test_decode(spark):
    doc = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 1, "exclusiveMaximum": 9}, "b": {"enum": ["x", "y"]}, "c": {"type": "string", "pattern": "b$", "maxLength": 3}, "d": {"type": "array", "items": {"type": "number"}, "uniqueItems": True, "contains": {"minimum": 5}}, "e": {"not": {"const": "no"}}, "f": {"oneOf": [{"minimum": 5}, {"multipleOf": 2}]}}}
    kind = "a double, b string, c string, d array<double>, e string, f int, g int"
    got = errors(spark, from_json_schema(doc), [(2.0, "x", "aab", [5.0, 1.0], "yes", 7, None), (2.5, "z", "aaaa", [1.0, 1.0], "no", 8, 1), (None, None, None, None, None, None, None)], kind)
    assert got[0] == []
    assert {p for p, _ in got[1]} == {"a", "b", "c", "d", "e", "f", "g"}
    assert got[2] == [("a", "required")]


def test_decode_refuses():
    for doc in ({"type": "object", "patternProperties": {}}, {"type": "object", "properties": {"a": {"$ref": "other.json"}}}, {"type": "object", "properties": {"a": {"type": "x"}}}, {"type": "object", "properties": {"a": {"enum": []}}}, {"type": "string"}, {"type": "object", "properties": {"a": {"pattern": "(a+)+$"}}}, {"type": "object", "properties": {"a": {"maximum": "1"}}}):
        with pytest.raises(SchemaError):
            from_json_schema(doc)
    deep: dict = {}
    for _ in range(150):
        deep = {"type": "array", "items": deep}
    with pytest.raises(SchemaError):
        from_json_schema({"type": "object", "properties": {"a": deep}})
    assert is_catastrophic("(a|a)*b") and not is_catastrophic(r"\A[a-z]+@[a-z]+\.com")


def test_round_trip(spark):
    c = Contract({Required("a"): f.Range(1, 5), Optional("b"): f.In(["x"]), Optional("n"): {Required("k"): str}})
    rows, kind = [(9, "y", (None,)), (2, "x", ("v",)), (None, None, None)], "a int, b string, n struct<k:string>"
    want, got = errors(spark, c, rows, kind), errors(spark, from_json_schema(to_json_schema(c)), rows, kind)
    assert [[p for p, _ in r] for r in got] == [[p for p, _ in r] for r in want]
    assert errors(spark, from_openapi({"type": "object", "properties": {"a": {"type": "integer", "nullable": True}}}), [(None,)], "a int") == [[]]


@dataclasses.dataclass
class Address:
    street: str
    number: int = 0


@dataclasses.dataclass
class User:
    name: typing.Annotated[str, f.NonEmpty()]
    address: Address
    age: int | None = None
    tags: list[str] = dataclasses.field(default_factory=list)
    kind: typing.Literal["a", "b"] = "a"


class Row(typing.TypedDict):
    a: int
    b: typing.NotRequired[dict[str, int]]


def test_annotations(spark):
    kind = "name string, address struct<street:string,number:int>, age int, tags array<string>, kind string"
    c = contract_of(User, {"age": f.Range(max=99)})
    assert errors(spark, c, [("", ("s", None), 100, None, "c"), (None, (None, 1), None, ["x"], None)], kind) == [[("age", "range"), ("kind", "not_in_list"), ("name", "length")], [("address.street", "required"), ("name", "required")]]
    row = c.apply(spark.createDataFrame([("n", ("s", None), None, None, None)], kind)).first()
    assert row.address.number == 0 and row.tags == [] and row.kind == "a"
    assert errors(spark, contract_of(Row), [(None, {"x": 1})], "a int, b map<string,int>") == [[("a", "required")]]
    with pytest.raises(SchemaError):
        contract_of(int)


def test_all_that_is_said_of_a_row(spark):
    doc = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "allOf": [{"required": ["a"]}, {"anyOf": [{"required": ["b"]}, {"properties": {"a": {"minimum": 5}}, "additionalProperties": True}]}], "not": {"required": ["b"], "properties": {"b": {"const": 7}}, "additionalProperties": True}}
    rows = [(1, 1), (None, 1), (1, None), (9, None), (1, 7)]
    for made in (from_json_schema(doc), from_json_schema(to_json_schema(from_json_schema(doc)))):
        assert [r.a for r in made.valid(spark.createDataFrame(rows, "a int, b int")).collect()] == [1, 9]
    assert [bool(e) for e in errors(spark, from_json_schema(doc).extend({}), rows, "a int, b int")] == [False, True, True, False, True]
