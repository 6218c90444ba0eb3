"""Mappings: the row itself, or a struct column; maps by the types of keys and values.

Null is absent. Defaults fill in before the value is checked, and are checked like any value. The order of errors is: keys in the contract's order,
extra keys, required keys, exclusive groups, inclusive groups, cross-field rules.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.operators.markers import UNDEFINED, Alias, Exclusive, Extra, Forbidden, Inclusive, Marker, Optional, Remove, Required, Secret
from pactframe.plans.nodes import ERRORS, Context, Node, SchemaError, Value, error, node

PREVENT_EXTRA, ALLOW_EXTRA, REMOVE_EXTRA = 0, 1, 2


class Mapping(Node):
    #: Whether ``Self`` inside stands for this mapping.
    bound = False

    def __init__(self, schema: dict, required: bool = False, extra: int = PREVENT_EXTRA):
        self.schema, self.required, self.extra = schema, required, extra
        self.fields: list[tuple[Marker, Node, bool]] = []
        self.extra_node = self.typed = None
        for k, v in schema.items():
            secret = False
            while isinstance(k, Secret):
                secret, k = True, getattr(k, "inner", k.key)
            if k is Extra:
                self.extra_node = node(v)
            elif isinstance(k, type) or isinstance(k, Node) or isinstance(k, Marker) and isinstance(k.key, type):
                self.typed = (node(k.key if isinstance(k, Marker) else k), node(v))
            else:
                marker = k if isinstance(k, Marker) else (Required(k) if required else Optional(k))
                self.fields.append((marker, node(v), secret))

    def __repr__(self) -> str:
        return repr(self.schema)

    def lower(self, v: Value, ctx: Context) -> Value:
        if self.bound:
            ctx = replace(ctx, root=self)
        if isinstance(v.type, T.MapType):
            return self._map(v, ctx)
        if not isinstance(v.type, T.StructType):
            return replace(v, errors=[*v.errors, v.failed(F.lit(True), "not_a_dictionary", "expected_mapping")])
        out, kinds, errors, lists, level, present = self.fields_of({f.name: (v.col[f.name], f.dataType) for f in v.type.fields}, v.path, v.level, ctx)
        made = F.struct(*[c.alias(k) for k, c in out.items()]) if out else v.col
        kind = T.StructType([T.StructField(k, t) for k, t in kinds.items()]) if out else v.type
        return ctx.bind(replace(v, col=F.when(v.col.isNotNull(), made), type=kind, errors=[*v.errors, *errors], lists=[*v.lists, *lists], level=level))

    def _map(self, v: Value, ctx: Context) -> Value:
        """Each key and value against the contract's type key; items that fail keep their place."""
        if not self.typed:
            raise SchemaError("a map column needs a type key")
        inner = ctx.inside()
        key_node, value_node = self.typed

        def entry(e: Column) -> Column:
            name = e["key"].cast("string")
            k = key_node.guarded(Value(e["key"], v.type.keyType, [*v.path, name]), inner)
            x = value_node.guarded(Value(e["value"], v.type.valueType, [*v.path, name]), inner)
            return F.struct(k.col.alias("key"), x.col.alias("value"), F.when(k.ok, x.all_errors()).otherwise(k.all_errors()).alias("errors"))

        probe_k = key_node.lower(Value(F.lit(None), v.type.keyType), inner).type
        probe_v = value_node.lower(Value(F.lit(None), v.type.valueType), inner).type
        done = ctx.bind(replace(v, col=F.transform(F.map_entries(v.col), entry)))
        # of keys that become equal the last counts; a key that became none has an error and no place
        fold = F.map_from_entries(F.transform(F.filter(done.col, lambda e, i: e["key"].isNotNull() & (F.size(F.filter(F.slice(done.col, i + 2, F.size(done.col)), lambda o: o["key"] == e["key"])) == 0)), lambda e: F.struct(e["key"], e["value"])))
        return replace(done, col=fold, type=T.MapType(probe_k, probe_v), lists=[*v.lists, F.flatten(F.transform(done.col, lambda e: e["errors"]))])

    def fields_of(self, columns: dict[str, tuple[Column, T.DataType]], path: list[Column], level: int, ctx: Context):
        """(values, types, errors, lists of errors, level, presence by key)."""
        out: dict[str, Column] = {}
        kinds: dict[str, T.DataType] = {}
        errors: list[Column] = []
        late: list[Column] = []
        lists: list[Column] = []
        present: dict[str, Column] = {}
        groups: dict[tuple[type, str], list[Marker]] = {}
        top = level
        known: set[str] = set()
        for marker, value_node, secret in self.fields:
            keys = self._several(marker)
            known |= set(keys or marker.names()) | ({marker.key} if not keys else set())
            if keys:
                there = reduce(lambda a, b: a | b, [columns[k][0].isNotNull() for k in keys if k in columns], F.lit(False))
                if marker.required:
                    late.append(F.when(~there, error([*path, F.lit(str(keys))], "required", marker.msg or "required_any_of")))
            for name in keys or [marker.key]:
                at = [*path, F.lit(name)]
                found = [columns[n] for n in (marker.names() if not keys else [name]) if n in columns]
                col = F.coalesce(*[c for c, _ in found]) if found else F.lit(None)
                kind = found[0][1] if found else None
                present[name] = col.isNotNull() if found else F.lit(False)
                if isinstance(marker, (Inclusive, Exclusive)):
                    groups.setdefault((type(marker), marker.group), []).append(marker)
                if isinstance(marker, Forbidden):
                    errors.append(F.when(present[name], error(at, "forbidden_key", marker.msg or "forbidden_key")))
                    continue
                default = marker.default() if not isinstance(marker, Exclusive) else UNDEFINED
                if default is not UNDEFINED:
                    filler = F.lit(default) if not isinstance(default, list) else (F.array(*map(F.lit, default)) if default else F.array().cast(kind or T.ArrayType(T.StringType())))
                    kind = kind or T.StringType() if not isinstance(default, (bool, int, float)) else kind or {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}[type(default)]
                    col = F.coalesce(col, filler.cast(kind) if default is not None else F.lit(None).cast(kind))
                elif marker.required and not keys:
                    late.append(F.when(~present[name], error(at, "required", marker.msg or "required")))
                if kind is None:
                    continue
                if not found and default is UNDEFINED:
                    continue
                done = value_node.lower(Value(col, kind, at, level=level), ctx)
                top = max(top, done.level)
                guard = col.isNotNull()
                if isinstance(marker, Remove):
                    # an invalid value leaves the key unconsumed: an extra key
                    if self.extra == PREVENT_EXTRA and self.extra_node is None:
                        errors.append(F.when(guard & ~done.ok, error(at, "extra_keys_not_allowed", "not_a_valid_option")))
                    continue
                mine = [F.when(guard, e) for e in done.errors]
                more = [F.when(guard, e).otherwise(F.array().cast(ERRORS)) for e in done.lists]
                if secret:
                    mine = [F.when(e.isNotNull(), F.struct(e["path"].alias("path"), e["code"].alias("code"), F.lit("secret").alias("key"))) for e in mine]
                    more = [F.transform(e, lambda x: F.struct(x["path"].alias("path"), x["code"].alias("code"), F.lit("secret").alias("key"))) for e in more]
                errors += mine
                lists += more
                out[name], kinds[name] = (done.col if value_node.takes_null() else F.when(guard, done.col)), done.type
        for name, (col, kind) in columns.items():
            if name in known:
                continue
            at = [*path, F.lit(name)]
            if self.extra_node is not None:
                done = self.extra_node.lower(Value(col, kind, at, level=level), ctx)
                top = max(top, done.level)
                errors += [F.when(col.isNotNull(), e) for e in done.errors]
                out[name], kinds[name] = done.col, done.type
            elif self.extra == PREVENT_EXTRA:
                errors.append(F.when(col.isNotNull(), error(at, "extra_keys_not_allowed", "not_a_valid_option")))
            elif self.extra == ALLOW_EXTRA:
                out[name], kinds[name] = col, kind
        errors += late
        for exclusive in (True, False):
            for (kind, group), markers in groups.items():
                if (kind is Exclusive) is not exclusive:
                    continue
                n = reduce(lambda a, b: a + b, [present[m.key].cast("int") for m in markers])
                msg, at = next((m.msg for m in markers if m.msg), None), [*path, F.lit(f"<{group}>")]
                if exclusive:
                    errors.append(F.when(n > 1, error(at, "exclusive", msg or "exclusive_group")))
                    filled = next((m for m in markers if m.default() is not UNDEFINED), None)
                    if filled is not None:
                        if filled.key in out:
                            out[filled.key] = F.when(n == 0, F.lit(filled.default()).cast(kinds[filled.key])).otherwise(out[filled.key])
                    elif any(m.one for m in markers):
                        errors.append(F.when(n == 0, error(at, "required", "required_one_of")))
                else:
                    errors.append(F.when((n > 0) & (n < len(markers)), error(at, "inclusive", msg or "inclusive_group")))
        return out, kinds, errors, lists, top, present

    @staticmethod
    def _several(marker: Marker) -> list[str] | None:
        branches = getattr(marker.key, "branches", None)
        return None if branches is None else [b.value for b in branches]

    def extended(self, other: dict | Mapping, required: bool | None = None, extra: int | None = None) -> Mapping:
        """Both contracts; of keys in both the other's counts, mappings in both are merged."""
        other = other.schema if isinstance(other, Mapping) else other
        own: dict[Any, Any] = dict(self.schema)
        for k, v in other.items():
            name = k.key if isinstance(k, Marker) else k
            old = next((x for x in own if (x.key if isinstance(x, Marker) else x) == name), None)
            if old is not None:
                before = own.pop(old)
                if isinstance(before, dict) and isinstance(v, dict):
                    v = Mapping(before).extended(v).schema
            own[k] = v
        return Mapping(own, self.required if required is None else required, self.extra if extra is None else extra)
