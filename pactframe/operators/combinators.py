"""Combinators: chains, alternatives, tagged and counted alternatives."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from typing import Any as Anything

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.operators.mapping import Mapping
from pactframe.operators.markers import Marker
from pactframe.plans.nodes import ERRORS, Context, LiteralNode, Node, SchemaError, Value, error, node


class All(Node):
    """One after the other, each on what the one before made; the first failure ends it."""

    def __init__(self, *branches, msg: str | None = None, required: bool = False):
        self.branches, self.msg = [node(b) for b in branches], msg

    def takes_null(self) -> bool:
        return bool(self.branches) and self.branches[0].takes_null()

    def lower(self, v: Value, ctx: Context) -> Value:
        now, ok = v.fresh(), F.lit(True)
        errors, lists = [], []
        for i, b in enumerate(self.branches):
            # after one that takes null, what follows sees values only if there are some
            skip = now.col.isNotNull() if i and self.takes_null() else F.lit(True)
            done = b.lower(now.fresh(), ctx)
            errors += [F.when(ok & skip, e) for e in done.errors]
            lists += [F.when(ok & skip, e).otherwise(F.array().cast(ERRORS)) for e in done.lists]
            if done.errors or done.lists:
                ok = ok & (done.ok | ~skip)
            now = done
        if self.msg:
            errors, lists = [v.failed(~ok, "all", self.msg)], []
        # errors that exclude one another become one
        if errors and not lists:
            errors = [reduce(lambda a, b: F.coalesce(a, b), errors)] if all(not isinstance(b, Mapping) for b in self.branches) else errors
        return replace(now, errors=[*v.errors, *errors], lists=[*v.lists, *lists])


class Any(Node):
    """The first branch that accepts. A miss is one error: ``no_match`` if all branches are plain values or types, else that of the last branch.

    Branches of several types give a string, numbers a double; structs of several types stay as they came."""

    def __init__(self, *branches, msg: str | None = None, required: bool = False):
        if not branches:
            raise SchemaError("no alternatives")
        self.branches, self.msg = [node(b) for b in branches], msg

    def takes_null(self) -> bool:
        return any(b.takes_null() for b in self.branches)

    def pick(self, v: Value) -> list[Column]:
        return [F.lit(True)] * len(self.branches)

    def lower(self, v: Value, ctx: Context) -> Value:
        from pactframe.plans.nodes import TypeNode

        tried = [b.lower(v.fresh(), ctx) for b in self.branches]
        allowed = self.pick(v)
        hit = [t.ok & a for t, a in zip(tried, allowed)]
        kind = tried[0].type
        if any(t.type != kind for t in tried):
            # alternatives of several types: those that can't match at all don't count, numbers widen, the rest are strings
            live = [t for b, t in zip(self.branches, tried)]
            kind = T.DoubleType() if all(isinstance(t.type, T.NumericType) for t in live) else T.StringType()
            if all(isinstance(t.type, T.StructType) for t in live):
                kind, tried = v.type, [replace(t, col=v.col) for t in tried]
        value = tried[-1].col.cast(kind)
        for h, t in reversed(list(zip(hit, tried))[:-1]):
            value = F.when(h, t.col.cast(kind)).otherwise(value)
        missed = ~reduce(lambda a, b: a | b, hit)
        top = max(t.level for t in tried)
        errors, lists = list(v.errors), list(v.lists)
        if self.msg or all(isinstance(b, (LiteralNode, TypeNode)) for b in self.branches):
            errors.append(v.failed(missed, "no_match", self.msg or "expected_one_of"))
        else:
            last = tried[-1]
            errors += [F.when(missed, e) for e in last.errors]
            lists += [F.when(missed, e).otherwise(F.array().cast(ERRORS)) for e in last.lists]
            if not last.errors and not last.lists:
                errors.append(v.failed(missed, "no_match", "expected_one_of"))
        return ctx.bind(replace(v, col=value, type=kind, errors=errors, lists=lists, level=top))


class Union(Any):
    """Like ``Any``; ``discriminant(column)`` gives a column with the number of the only branch to try."""

    def __init__(self, *branches, msg: str | None = None, discriminant=None):
        super().__init__(*branches, msg=msg)
        self.discriminant = discriminant

    def pick(self, v: Value) -> list[Column]:
        if self.discriminant is None:
            return super().pick(v)
        at = self.discriminant(v.col)
        return [F.coalesce(at == i, F.lit(False)) for i in range(len(self.branches))]


class TaggedUnion(Node):
    """The contract of a struct depends on the value of one of its keys; an unknown tag is an error at the key."""

    def __init__(self, key: str, cases: dict, default: Anything = None, msg: str | None = None):
        self.key, self.msg = key, msg
        self.cases = {t: node(c) for t, c in cases.items()}
        self.default = None if default is None else node(default)

    def lower(self, v: Value, ctx: Context) -> Value:
        if not isinstance(v.type, T.StructType) or self.key not in v.type.names:
            return replace(v, errors=[*v.errors, v.failed(F.lit(True), "not_a_dictionary", "expected_mapping")])
        tag, errors, lists = v.col[self.key], list(v.errors), list(v.lists)
        top, none = v.level, F.coalesce(reduce(lambda a, b: a | b, [tag == F.lit(t) for t in self.cases]), F.lit(False))
        for is_case, case in [*[(F.coalesce(tag == F.lit(t), F.lit(False)), c) for t, c in self.cases.items()], *([(~none, self.default)] if self.default else [])]:
            done = case.lower(v.fresh(), ctx)
            errors += [F.when(is_case, e) for e in done.errors]
            lists += [F.when(is_case, e).otherwise(F.array().cast(ERRORS)) for e in done.lists]
            top = max(top, done.level)
        if self.default is None:
            errors.append(F.when(~none, error([*v.path, F.lit(self.key)], "value", self.msg or "expected_discriminator")))
        return replace(v, errors=errors, lists=lists, level=top)


class SomeOf(Node):
    """Between ``min_valid`` and ``max_valid`` branches accept; each sees what the accepting ones before it made."""

    def __init__(self, validators: list, min_valid: int | None = None, max_valid: int | None = None, msg: str | None = None):
        if min_valid is None and max_valid is None:
            raise SchemaError("a bound is needed")
        self.branches, self.msg = [node(b) for b in validators], msg
        self.low, self.high = min_valid or 0, len(validators) if max_valid is None else max_valid

    def lower(self, v: Value, ctx: Context) -> Value:
        now, n = v.fresh(), F.lit(0)
        for b in self.branches:
            done = b.lower(now.fresh(), ctx)
            n = n + done.ok.cast("int")
            now = done.fresh() if done.col is now.col else replace(done.fresh(), col=F.when(done.ok, done.col.cast(now.type)).otherwise(now.col), type=now.type)
        few = v.failed(n < self.low, "not_enough_valid", self.msg or "not_enough_valid")
        many = v.failed(n > self.high, "too_many_valid", self.msg or "too_many_valid")
        return replace(now, errors=[*v.errors, F.coalesce(few, many)], lists=v.lists)


class Maybe(Node):
    """Null, or what the contract accepts."""

    def __init__(self, inner, msg: str | None = None):
        self.inner, self.msg = node(inner), msg

    def takes_null(self) -> bool:
        return True

    def lower(self, v: Value, ctx: Context) -> Value:
        done = self.inner.lower(v.fresh(), ctx)
        there = v.col.isNotNull()
        errors = [F.when(there, e) for e in done.errors]
        if self.msg:
            errors = [v.failed(there & ~done.ok, "no_match", self.msg)]
        return replace(done, errors=[*v.errors, *errors], lists=[*v.lists, *[F.when(there, e).otherwise(F.array().cast(ERRORS)) for e in done.lists]])


class Msg(Node):
    """One error with a message of its own in place of whatever the contract finds."""

    def __init__(self, inner, msg: str, code: str = "value"):
        self.inner, self.msg, self.code = node(inner), msg, code

    def lower(self, v: Value, ctx: Context) -> Value:
        done = self.inner.lower(v.fresh(), ctx)
        return replace(done, errors=[*v.errors, v.failed(~done.ok, self.code, self.msg)], lists=v.lists)


And, Or, Switch = All, Any, Union
__all__ = ["All", "And", "Any", "Marker", "Maybe", "Msg", "Or", "SomeOf", "Switch", "TaggedUnion", "Union"]
