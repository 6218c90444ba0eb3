"""Nodes of a contract and how they are lowered to columns.

A node turns a ``Value`` into another: a column with its type, and the errors found on the way. An error is a nullable struct
(path, code, key), null if there is none, so that whole-stage code generation holds; items of arrays give an array of such structs. Checks only see values
that aren't null: what a null means is up to the mapping, the array or ``Maybe`` around them.

Transformed values are bound to columns of their own, one projection a stage, so that a chain of transforms doesn't multiply its expressions. Inside
arrays, where no column can be bound, they are put in place.
"""

from __future__ import annotations

import enum
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ERROR = "struct<path:array<string>,code:string,key:string>"
ERRORS = f"array<{ERROR}>"


class SchemaError(Exception):
    """The contract itself is wrong."""


@dataclass
class Context:
    """Columns to bind, stage by stage; ``inline`` inside arrays; ``root`` is what ``Self`` stands for."""

    stages: list[dict[str, Column]] = field(default_factory=list)
    inline: bool = False
    root: Node | None = None

    def inside(self) -> Context:
        """That of an array's or map's items."""
        return Context(inline=True, root=self.root)

    def bind(self, value: Value) -> Value:
        if self.inline:
            return value
        while len(self.stages) <= value.level:
            self.stages.append({})
        name = f"__bound_{sum(map(len, self.stages))}"
        self.stages[value.level][name] = value.col
        return replace(value, col=F.col(name), level=value.level + 1)


@dataclass
class Value:
    col: Column
    type: T.DataType
    path: list[Column] = field(default_factory=list)
    errors: list[Column] = field(default_factory=list)
    lists: list[Column] = field(default_factory=list)
    level: int = 0

    @property
    def ok(self) -> Column:
        out = F.lit(True)
        for e in self.errors:
            out = out & e.isNull()
        for e in self.lists:
            out = out & (F.size(e) == 0)
        return out

    def failed(self, bad: Column, code: str, key: str) -> Column:
        return F.when(bad, error(self.path, code, key))

    def fresh(self) -> Value:
        return replace(self, errors=[], lists=[])

    def all_errors(self) -> Column:
        """One array, in order, without nulls."""
        found = F.array(*self.errors).cast(ERRORS) if self.errors else F.array().cast(ERRORS)
        if self.errors:
            found = F.filter(found, lambda e: e.isNotNull())
        return F.concat(found, *self.lists) if self.lists else found


def error(path: list[Column], code: str, key: str) -> Column:
    at = F.array(*path) if path else F.array().cast("array<string>")
    return F.struct(at.alias("path"), F.lit(code).alias("code"), F.lit(key).alias("key"))


class Node:
    """Something that a value is held against."""

    def lower(self, v: Value, ctx: Context) -> Value:
        raise NotImplementedError

    def takes_null(self) -> bool:
        return False

    def guarded(self, v: Value, ctx: Context) -> Value:
        """Like ``lower`` for a value that may be null: null counts as of the wrong type unless the node takes it."""
        if self.takes_null():
            return self.lower(v, ctx)
        out = self.lower(v, ctx)
        mine = [F.when(v.col.isNotNull(), e) for e in out.errors]
        lists = [F.when(v.col.isNotNull(), e).otherwise(F.array().cast(ERRORS)) for e in out.lists]
        return replace(out, errors=[v.failed(v.col.isNull(), "type", "expected_type"), *mine], lists=lists)


class Check(Node):
    """A value stays as it is, or fails. ``test`` gives what must hold, or several of that with their keys, of which the first that fails counts."""

    def __init__(self, name: str, test: Callable, params: dict, code: str, key: str, msg: str | None):
        self.name, self.test, self.params, self.code, self.key, self.msg = name, test, params, code, key, msg

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.params.items() if v is not None)})"

    def lower(self, v: Value, ctx: Context) -> Value:
        held = self.test(v.col, v.type, **self.params)
        held = held if isinstance(held, list) else [(held, self.key)]
        found = None
        for ok, key in held:
            bad = ~F.coalesce(ok, F.lit(False))
            e = error(v.path, self.code, self.msg or key)
            found = F.when(bad, e) if found is None else found.when(bad, e)
        return replace(v, errors=[*v.errors, found])


class Transform(Node):
    """A new value, or a failure: ``make`` gives (column, type, what must hold or None for always)."""

    def __init__(self, name: str, make: Callable, params: dict, code: str, key: str, msg: str | None, null: bool = False):
        self.name, self.make, self.params, self.code, self.key, self.msg, self.null = name, make, params, code, key, msg, null

    __repr__ = Check.__repr__

    def takes_null(self) -> bool:
        return self.null

    def lower(self, v: Value, ctx: Context) -> Value:
        col, kind, ok = self.make(v.col, v.type, **self.params)
        errors = v.errors if ok is None else [*v.errors, v.failed(~F.coalesce(ok, F.lit(False)), self.code, self.msg or self.key)]
        return ctx.bind(replace(v, col=col, type=kind, errors=errors))


def _factory(kind: type, code: str, key: str | None, **more) -> Callable:
    """Make a public constructor of a test or a transform over (column, type, parameters)."""

    def wrap(fn: Callable) -> Callable:
        import inspect

        names = list(inspect.signature(fn).parameters.values())[2:]
        takes = inspect.Signature([*[p.replace(kind=inspect.Parameter.POSITIONAL_OR_KEYWORD) for p in names], inspect.Parameter("msg", inspect.Parameter.KEYWORD_ONLY, default=None)])

        def make(*args, **kwargs) -> Node:
            try:
                bound = takes.bind(*args, **kwargs)
            except TypeError as e:
                raise SchemaError(f"{fn.__name__}: {e}") from None
            bound.apply_defaults()
            params = dict(bound.arguments)
            msg = params.pop("msg")
            if hasattr(fn, "verify"):
                fn.verify(**params)
            return kind(fn.__name__, fn, params, code, key or code, msg, **more)

        make.__name__, make.__doc__, make.rule = fn.__name__, fn.__doc__, fn
        return make

    return wrap


def check(code: str, key: str | None = None) -> Callable:
    return _factory(Check, code, key)


def transform(code: str, key: str | None = None, null: bool = False) -> Callable:
    return _factory(Transform, code, key, null=null)


def verified(rule: Callable) -> Callable:
    """Parameters are verified by ``rule`` when the node is made."""

    def wrap(fn):
        fn.verify = rule
        return fn

    return wrap


def numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def integral(t: T.DataType) -> bool:
    return isinstance(t, T.IntegralType) or isinstance(t, T.DecimalType) and t.scale == 0


def text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def sized(c: Column, t: T.DataType) -> Column | None:
    """Length of a string, an array or a map."""
    if text(t):
        return F.length(c)
    if isinstance(t, T.BinaryType):
        return F.octet_length(c)
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.size(c)
    return None


def comparable(t: T.DataType, value: Any) -> bool:
    """Whether a literal can be equal to values of a type."""
    if isinstance(value, enum.Enum):
        value = value.value
    if isinstance(value, bool):
        return isinstance(t, T.BooleanType) or numeric(t)
    if isinstance(value, (int, float)):
        return numeric(t) or isinstance(t, T.BooleanType)
    if isinstance(value, str):
        return text(t)
    return True


def equals(c: Column, t: T.DataType, value: Any) -> Column:
    if isinstance(value, enum.Enum):
        value = value.value
    if value is None:
        return c.isNull()
    if not comparable(t, value):
        return F.lit(False)
    if isinstance(value, bool) and numeric(t):
        value = int(value)
    if isinstance(t, T.BooleanType) and not isinstance(value, bool):
        return F.lit(False) if value not in (0, 1) else c == F.lit(bool(value))
    return F.coalesce(c == F.lit(value), F.lit(False))


class TypeNode(Node):
    """A plain type: decided from the column's type, so that a match costs nothing. ``float`` takes whole numbers and makes them doubles."""

    def __init__(self, kind: type):
        self.kind = kind

    def __repr__(self) -> str:
        return self.kind.__name__

    def lower(self, v: Value, ctx: Context) -> Value:
        t, k = v.type, self.kind
        if k is float and numeric(t) and not isinstance(t, T.DoubleType):
            return ctx.bind(replace(v, col=v.col.cast("double"), type=T.DoubleType()))
        fits = {str: text(t), int: integral(t) or isinstance(t, T.BooleanType), float: isinstance(t, T.DoubleType), bool: isinstance(t, T.BooleanType), bytes: isinstance(t, T.BinaryType), list: isinstance(t, T.ArrayType), dict: isinstance(t, (T.MapType, T.StructType)), object: True}.get(k)
        if fits is None:
            raise SchemaError(f"no column type stands for {k}")
        return v if fits else replace(v, errors=[*v.errors, v.failed(F.lit(True), "type", "expected_type")])


class LiteralNode(Node):
    def __init__(self, value: Any):
        self.value = value

    def __repr__(self) -> str:
        return repr(self.value)

    def takes_null(self) -> bool:
        return self.value is None

    def lower(self, v: Value, ctx: Context) -> Value:
        return replace(v, errors=[*v.errors, v.failed(~equals(v.col, v.type, self.value), "not_valid", "not_a_valid_value")])


class _Self(Node):
    """The contract around it, for what nests in itself. It ends where the column's type does, as that is finite."""

    def __repr__(self) -> str:
        return "Self"

    def lower(self, v: Value, ctx: Context) -> Value:
        if ctx.root is None:
            raise SchemaError("Self needs a contract around it")
        return ctx.root.lower(v, ctx)


Self = _Self()


class EnumNode(Node):
    """A member's value; the result is the value, as columns hold no members."""

    def __init__(self, kind: type[enum.Enum]):
        self.kind = kind

    def lower(self, v: Value, ctx: Context) -> Value:
        hit = F.lit(False)
        for m in self.kind:
            hit = hit | equals(v.col, v.type, m.value)
        return replace(v, errors=[*v.errors, v.failed(~hit, "enum", "expected_one_of")])


def node(schema: Any) -> Node:
    """The node of what a user writes: nodes, types, enumerations, mappings, sequences, predicates over columns, literals."""
    from pactframe.operators.mapping import Mapping
    from pactframe.operators.sequence import Sequence

    if isinstance(schema, Node):
        return schema
    if hasattr(schema, "root") and isinstance(schema.root, Node):
        return schema.root
    if isinstance(schema, type):
        return EnumNode(schema) if issubclass(schema, enum.Enum) else TypeNode(schema)
    if isinstance(schema, dict):
        return Mapping(schema)
    if isinstance(schema, (list, tuple, set, frozenset)):
        return Sequence(list(schema), distinct=isinstance(schema, (set, frozenset)))
    if callable(schema):
        if getattr(schema, "rule", None) is not None:  # a constructor without its parentheses
            return schema()
        return Check(getattr(schema, "__name__", "callable"), lambda c, t: schema(c), {}, "value", "not_a_valid_value", None)
    return LiteralNode(schema)
