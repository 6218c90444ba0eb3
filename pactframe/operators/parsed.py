"""JSON text as a value: parsed, its types told row by row, then held against a contract."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.operators.mapping import PREVENT_EXTRA, Mapping
from pactframe.plans.nodes import ERRORS, Context, Node, SchemaError, Value, error, node, text


def _form(t: T.DataType) -> str:
    """What Spark calls the type of a JSON value that fits: whole numbers are numbers, ``5.0`` isn't a whole one, booleans are neither."""
    if isinstance(t, T.BooleanType):
        return "BOOLEAN"
    if isinstance(t, T.IntegralType):
        return "BIGINT"
    if isinstance(t, T.NumericType):
        return r"(?:BIGINT|FLOAT|DOUBLE|DECIMAL\(\d+,\d+\))"
    if isinstance(t, T.StringType):
        return "STRING"
    if isinstance(t, T.ArrayType):
        return f"ARRAY<(?:VOID|{_form(t.elementType)})>"
    if isinstance(t, (T.StructType, T.MapType)):
        return "OBJECT<.*>"
    raise SchemaError(f"JSON has no {t.simpleString()}")


class FromJSONString(Node):
    """The value of a JSON text of the type ``kind`` (DDL), held against ``schema``. ``keep``: the text stays as it is.

    Text that isn't JSON, or repeats a key, is one error ``json``. A value of another type is an error ``type`` at its path: nothing is cast. Keys that neither
    ``kind`` nor the contract knows are extra keys where the contract prevents them. An array's items have one type: an item of another
    is an error of the array. Inside structs that are items of arrays extra keys aren't seen.
    """

    def __init__(self, schema: Any, kind: str, keep: bool = False, msg: str | None = None):
        self.inner, self.kind, self.keep, self.msg = node(schema), T.DataType.fromDDL(kind), keep, msg
        _form(self.kind)
        if not isinstance(self.kind, (T.StructType, T.ArrayType, T.MapType)):
            raise SchemaError("a JSON text holds an object or an array")

    def __repr__(self) -> str:
        return f"FromJSONString({self.inner!r})"

    def lower(self, v: Value, ctx: Context) -> Value:
        if not text(v.type):
            return replace(v, errors=[*v.errors, v.failed(F.lit(True), "json", self.msg or "expected_json_string")])
        # bound, so that each text is parsed and told once
        once = ctx.bind(replace(v.fresh(), col=F.try_parse_json(v.col), type=T.VariantType()))
        bad, told, extra = once.col.isNull(), [], []
        self._told(self.kind, self.inner, [], v, once.col, told, extra)
        fits = ~bad
        for e in told:
            fits = fits & e.isNull()
        held = ctx.bind(replace(once, col=fits, type=T.BooleanType()))
        right = held.col
        # text of the right types alone is read and checked further
        read = ctx.bind(replace(held, col=F.from_json(F.when(right, v.col), self.kind), type=self.kind))
        done = self.inner.guarded(read, ctx)
        none = F.array().cast(ERRORS)
        errors = [v.failed(bad, "json", self.msg or "expected_json_string"), *told, *[F.when(right, e) for e in done.errors]]
        lists = [*[F.when(bad, none).otherwise(e) for e in extra], *[F.when(right, e).otherwise(none) for e in done.lists]]
        out = replace(done, errors=[*v.errors, *errors], lists=[*v.lists, *lists])
        return replace(out, col=v.col, type=v.type) if self.keep else out

    def _told(self, t: T.DataType, n: Node | None, at: list[str], v: Value, parsed: Column, told: list, extra: list) -> None:
        where = "$" + "".join(f"['{k}']" for k in at)
        path = [*v.path, *map(F.lit, at)]
        here = F.try_variant_get(parsed, where, "variant")
        told.append(F.when(here.isNotNull() & ~F.schema_of_variant(here).rlike(rf"\A(?:VOID|{_form(t)})\z"), error(path, "type", "expected_type")))
        if not isinstance(t, T.StructType):
            return
        inner = {marker.key: x for marker, x, _ in n.fields} if isinstance(n, Mapping) else {}
        if isinstance(n, Mapping) and n.extra == PREVENT_EXTRA and n.extra_node is None:
            keys = F.json_object_keys(F.get_json_object(v.col, where) if at else v.col)
            known = F.array(*map(F.lit, t.names)) if t.names else F.array().cast("array<string>")
            extra.append(F.coalesce(F.transform(F.array_except(keys, known), lambda k: error([*path, k], "extra_keys_not_allowed", "not_a_valid_option")), F.array().cast(ERRORS)))
        for field in t.fields:
            self._told(field.dataType, inner.get(field.name), [*at, field.name], v, parsed, told, extra)
