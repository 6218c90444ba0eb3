"""``Contract``: what a user declares and applies to a DataFrame."""

from __future__ import annotations

import difflib
import functools
import inspect
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.operators.mapping import ALLOW_EXTRA, PREVENT_EXTRA, REMOVE_EXTRA, Mapping
from pactframe.operators.markers import Optional, Required
from pactframe.operators.rules import Rule
from pactframe.plans.nodes import ERRORS, Context, Node, SchemaError, Value

__all__ = ["ALLOW_EXTRA", "PREVENT_EXTRA", "REMOVE_EXTRA", "Contract", "ContractError", "rendered", "validated"]


class ContractError(ValueError):
    """Rows broke a contract that all of them must keep."""


def rendered(errors: str = "errors") -> Column:
    """An array of errors as one text, a line each: path, key and code. Nothing of the values is in it."""
    path = lambda e: F.when(F.size(e["path"]) > 0, F.regexp_replace(F.array_join(e["path"], "."), r"\.\[", "[")).otherwise("<row>")
    return F.array_join(F.transform(errors, lambda e: F.concat(path(e), F.lit(": "), e["key"], F.lit(" ("), e["code"], F.lit(")"))), "\n")


def validated(returns: Contract | None = None, **contracts: Contract):
    """Decorates a function over DataFrames: arguments are checked and normalised by name, and so is what it returns."""

    def wrap(fn):
        signature = inspect.signature(fn)
        if unknown := contracts.keys() - signature.parameters.keys():
            raise SchemaError(f"no parameter {sorted(unknown)}")

        @functools.wraps(fn)
        def run(*args, **kwargs):
            bound = signature.bind(*args, **kwargs)
            for name, c in contracts.items():
                if name in bound.arguments:
                    bound.arguments[name] = c.check(bound.arguments[name])
            out = fn(*bound.args, **bound.kwargs)
            return out if returns is None else returns.check(out)

        return run

    return wrap


class Contract:
    """A mapping contract over the rows of a DataFrame, and rules across their fields.

    Results are expressions of the input: no Python runs on rows, nothing is shuffled, unused columns aren't read. Bad data gives errors in
    a column, a bad contract raises ``SchemaError`` when it is made. Null is absent.
    """

    def __init__(self, schema: dict | Contract, required: bool = False, extra: int = PREVENT_EXTRA, rules: list[Rule] | tuple = ()):
        if isinstance(schema, Contract):
            self.root, self.rules, self.also = schema.root, [*schema.rules, *rules], list(schema.also)
            return
        if not isinstance(schema, dict):
            raise SchemaError("a contract is a mapping of keys to contracts")
        self.root, self.rules = Mapping(schema, required, extra), list(rules)
        self.root.bound = True
        #: Nodes that the row, as a struct, is held against besides.
        self.also: list[Node] = []

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Contract) and (self.root.schema, self.root.required, self.root.extra) == (other.root.schema, other.root.required, other.root.extra)

    __hash__ = None

    def __repr__(self) -> str:
        return f"Contract({self.root!r})"

    def extend(self, schema: dict | Contract, required: bool | None = None, extra: int | None = None) -> Contract:
        """This contract and another, which counts where both have a key."""
        out = Contract({})
        out.root = self.root.extended(schema.root if isinstance(schema, Contract) else schema, required, extra)
        out.root.bound = True
        out.also = [*self.also, *(schema.also if isinstance(schema, Contract) else [])]
        out.rules = [*self.rules, *(schema.rules if isinstance(schema, Contract) else [])]
        return out

    @classmethod
    def infer(cls, example: dict[str, Any]) -> Contract:
        """Of an example: the types of its values."""

        def of(x):
            if isinstance(x, dict):
                return {Required(k): of(v) for k, v in x.items()}
            if isinstance(x, (list, tuple)):
                kinds = [of(v) for v in x]
                return [k for i, k in enumerate(kinds) if k not in kinds[:i]]
            return type(x) if x is not None else None

        return cls(of(example))

    @classmethod
    def of_schema(cls, schema: T.StructType) -> Contract:
        """Of a DataFrame's schema: fields that can't be null are required."""

        def of(t: T.DataType):
            if isinstance(t, T.StructType):
                return {(Optional if f.nullable else Required)(f.name): of(f.dataType) for f in t.fields}
            if isinstance(t, T.ArrayType):
                return [of(t.elementType)]
            if isinstance(t, T.MapType):
                return {of(t.keyType): of(t.valueType)}
            if isinstance(t, T.BooleanType):
                return bool
            if isinstance(t, T.IntegralType):
                return int
            if isinstance(t, T.NumericType):
                return float
            return str if isinstance(t, T.StringType) else object

        return cls(of(schema))

    def _lowered(self, df: DataFrame):
        ctx = Context(root=self.root)
        columns = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}
        out, kinds, errors, lists, _, _ = self.root.fields_of(columns, [], 0, ctx)
        row = Value(F.struct(*[c.alias(k) for k, (c, _) in columns.items()]), df.schema)
        for n in self.also:
            done = n.lower(row, ctx)
            errors, lists = [*errors, *done.errors], [*lists, *done.lists]
        for rule in self.rules:
            errors += rule.errors(lambda k: columns[k][0] if k in columns else F.lit(None))
        for stage in ctx.stages:
            df = df.withColumns(stage)
        return df, out, errors, lists

    def suggestions(self, df: DataFrame) -> dict[str, list[str]]:
        """For each column the contract doesn't know, its keys that are written alike."""
        known = [n for marker, _, _ in self.root.fields for n in (Mapping._several(marker) or marker.names())]
        return {c: difflib.get_close_matches(c, known) for c in df.columns if c not in known}

    def check(self, df: DataFrame, most: int = 20) -> DataFrame:
        """``df`` normalised if all of it is valid, else ``ContractError`` with the counts of at most ``most`` kinds of errors. Reads ``df`` once more."""
        found = self.report(df).orderBy(F.desc("n"), "path", "code").limit(most).collect()
        if found:
            raise ContractError("; ".join(f"{r.path or '<row>'}: {r.code} ({r.n})" for r in found))
        return self.apply(df).drop("errors")

    @staticmethod
    def _array(errors: list[Column], lists: list[Column]) -> Column:
        found = F.filter(F.array(*errors).cast(ERRORS), lambda e: e.isNotNull()) if errors else F.array().cast(ERRORS)
        return F.concat(found, *lists) if lists else found

    def apply(self, df: DataFrame, errors: str = "errors") -> DataFrame:
        """Normalised columns and the array of errors of each row."""
        bound, out, found, lists = self._lowered(df)
        return bound.select(*[c.alias(k) for k, c in out.items()], self._array(found, lists).alias(errors))

    def errors(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """(keep..., path, code, key): a row for each error."""
        bound, _, found, lists = self._lowered(df)
        rows = bound.select(*[F.col(k).alias(k) for k in keep], F.explode(self._array(found, lists)).alias("__e"))
        return rows.select(*keep, F.array_join("__e.path", ".").alias("path"), "__e.code", "__e.key")

    def report(self, df: DataFrame) -> DataFrame:
        """(path, code, n): how often each error occurs, indexes of arrays left out. Counts are added up before they are shuffled."""
        bound, _, found, lists = self._lowered(df)
        rows = bound.select(F.explode(self._array(found, lists)).alias("e"))
        path = F.regexp_replace(F.array_join("e.path", "."), r"\.?\[\d+\]", "[]")
        return rows.groupBy(path.alias("path"), F.col("e.code").alias("code")).agg(F.count("*").alias("n"))

    def valid(self, df: DataFrame) -> DataFrame:
        """The rows without an error, normalised."""
        bound, out, found, lists = self._lowered(df)
        return bound.filter(self._ok(found, lists)).select(*[c.alias(k) for k, c in out.items()])

    def invalid(self, df: DataFrame) -> DataFrame:
        """The rows with errors, as they came, with the array of errors."""
        bound, _, found, lists = self._lowered(df)
        return bound.filter(~self._ok(found, lists)).withColumn("errors", self._array(found, lists)).select(*[f"`{c}`" for c in df.columns], "errors")

    @staticmethod
    def _ok(found, lists) -> Column:
        ok = F.lit(True)
        for e in found:
            ok = ok & e.isNull()
        for e in lists:
            ok = ok & (F.size(e) == 0)
        return ok


