"""Rules across fields of a row, and between a row and its predecessor."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactframe.plans.nodes import ERRORS, SchemaError, error


@dataclass
class Rule:
    """``errors(columns)``: nullable error structs; ``columns`` gives a field's column by name, null where it is absent."""

    def errors(self, column) -> list[Column]:
        raise NotImplementedError


def _n(column, keys) -> Column:
    return reduce(lambda a, b: a + b, [column(k).isNotNull().cast("int") for k in keys])


def _missing(keys, column, when: Column, msg) -> list[Column]:
    """Of the first that is missing."""
    found = [F.when(when & column(k).isNull(), error([F.lit(k)], "required", msg or "required")) for k in keys]
    return [F.coalesce(*found) if len(found) > 1 else found[0]]


class RequiredWith(Rule):
    """With one of the triggers (or all of them) the other keys are required."""

    def __init__(self, trigger, *required: str, mode: str = "any", msg: str | None = None):
        if not required or mode not in ("any", "all"):
            raise SchemaError("keys and a mode are needed")
        self.trigger, self.required, self.mode, self.msg = ([trigger] if isinstance(trigger, str) else list(trigger)), required, mode, msg

    def when(self, column) -> Column:
        there = [column(k).isNotNull() for k in self.trigger]
        return reduce((lambda a, b: a | b) if self.mode == "any" else (lambda a, b: a & b), there)

    def errors(self, column):
        return _missing(self.required, column, self.when(column), self.msg)


class RequiredWithout(RequiredWith):
    """Without one of the triggers (or all of them) the other keys are required."""

    def when(self, column):
        gone = [column(k).isNull() for k in self.trigger]
        return reduce((lambda a, b: a | b) if self.mode == "any" else (lambda a, b: a & b), gone)


class RequiredIf(RequiredWith):
    """Where fields have given values the other keys are required."""

    def __init__(self, values: dict[str, Any], *required: str, mode: str = "all", msg: str | None = None):
        super().__init__(list(values), *required, mode=mode, msg=msg)
        self.values = values

    def when(self, column):
        same = [F.coalesce(column(k) == F.lit(v), F.lit(False)) for k, v in self.values.items()]
        return reduce((lambda a, b: a | b) if self.mode == "any" else (lambda a, b: a & b), same)


class AtLeastOne(Rule):
    def __init__(self, *keys: str, msg: str | None = None):
        self.keys, self.msg = keys, msg

    def errors(self, column):
        return [F.when(_n(column, self.keys) == 0, error([], "required", self.msg or "required_at_least_one_of"))]


class AtMostOne(AtLeastOne):
    """One error for each key that is present."""

    def errors(self, column):
        many = _n(column, self.keys) > 1
        return [F.when(many & column(k).isNotNull(), error([F.lit(k)], "exclusive", self.msg or "allowed_at_most_one_of")) for k in self.keys]


class ExactlyOne(AtLeastOne):
    def errors(self, column):
        n = _n(column, self.keys)
        return [F.when(n == 0, error([], "required", self.msg or "required_one_of")), *[F.when((n > 1) & column(k).isNotNull(), error([F.lit(k)], "exclusive", self.msg or "allowed_one_of")) for k in self.keys]]


class AllOrNone(AtLeastOne):
    """One error for each key that is missing."""

    def errors(self, column):
        n = _n(column, self.keys)
        return [F.when((n > 0) & column(k).isNull(), error([F.lit(k)], "inclusive", self.msg or "required_together")) for k in self.keys]


class Row(Rule):
    """``Check`` over the whole row: ``predicate(column)`` gives a boolean column; null counts as failed."""

    def __init__(self, predicate, msg: str | None = None):
        self.predicate, self.msg = predicate, msg

    def errors(self, column):
        return [F.when(~F.coalesce(self.predicate(column), F.lit(False)), error([], "value", self.msg or "not_a_valid_value"))]


class Immutable:
    """Fields that keep their value once the row before and the row have one."""

    code, key, once = "immutable", "cannot_be_changed", False

    def __init__(self, *fields: str):
        if not fields:
            raise SchemaError("fields are needed")
        self.fields = fields

    def errors(self, now, before) -> list[Column]:
        out = []
        for f in self.fields:
            changed = before(f).isNotNull() & (~now(f).eqNullSafe(before(f)) if self.once else now(f).isNotNull() & (now(f) != before(f)))
            out.append(F.when(changed, error([F.lit(f)], self.code, self.key)))
        return out


class WriteOnce(Immutable):
    """Fields that, once written, keep their value and aren't removed."""

    once = True


def against(df: DataFrame, before: DataFrame, rules: list[Immutable], *, key: str, name: str = "errors") -> DataFrame:
    """``df`` and the errors of each row against the row of its key in ``before``, a snapshot with one row a key at most. One join on the key, of the
    rules' fields only; rows whose key is new or null have nothing to break. However many rows of ``df`` share a key, none waits for another."""
    fields = sorted({f for r in rules for f in r.fields})
    old = before.select(F.col(key).alias("__key"), F.struct(*fields).alias("__before"))
    both = df.join(old, df[key] == F.col("__key"), "left")
    found = F.array(*[e for r in rules for e in r.errors(F.col, lambda f: F.col("__before")[f])]).cast(ERRORS)
    return both.withColumn(name, F.filter(found, lambda e: e.isNotNull())).drop("__before", "__key")


def transitions(df: DataFrame, rules: list[Immutable], *, key: str, order: list[str], name: str = "errors") -> DataFrame:
    """``df`` and the errors of each row against the one before it of its key. Rows of a key are ordered in one task: a key must fit there."""
    w = Window.partitionBy(key).orderBy(*order)
    fields = sorted({f for r in rules for f in r.fields})
    both = df.withColumn("__before", F.lag(F.struct(*fields)).over(w))
    found = F.array(*[e for r in rules for e in r.errors(F.col, lambda f: F.col("__before")[f])]).cast(ERRORS)
    return both.withColumn(name, F.filter(found, lambda e: e.isNotNull())).drop("__before")
