"""Arrays: every item matches one of the element contracts; all items that don't are told, with their index."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe.operators.markers import Remove
from pactframe.plans.nodes import ERRORS, Context, Node, Value, node


def index(i: Column) -> Column:
    return F.concat(F.lit("["), i.cast("string"), F.lit("]"))


class Sequence(Node):
    def __init__(self, items: list, distinct: bool = False):
        self.distinct = distinct
        self.dropped = [node(x.key) for x in items if isinstance(x, Remove)]
        self.items = [node(x) for x in items if not isinstance(x, Remove)]

    def _checks(self, of: T.DataType, ctx: Context) -> bool:
        """Whether the only element contract leaves items as they are."""
        probe = F.lit(None)
        return self.items[0].lower(Value(probe, of), ctx).col is probe

    def lower(self, v: Value, ctx: Context) -> Value:
        if not isinstance(v.type, T.ArrayType):
            return replace(v, errors=[*v.errors, v.failed(F.lit(True), "not_a_sequence", "expected_sequence")])
        inner, of = ctx.inside(), v.type.elementType
        kind = of
        for x in self.items:
            kind = x.lower(Value(F.lit(None), of), inner).type

        def one(c: Column, i: Column) -> Column:
            at = [*v.path, index(i)]
            tried = [x.guarded(Value(c, of, at), inner) for x in self.items]
            gone = F.lit(False)
            for x in self.dropped:
                gone = gone | x.guarded(Value(c, of, at), inner).ok
            if not tried:
                from pactframe.plans.nodes import error

                value, errors = c, F.array(error(at, "not_valid", "not_a_valid_value")).cast(ERRORS)
            else:
                value, errors = tried[-1].col, tried[-1].all_errors()
                for t in reversed(tried[:-1]):
                    value, errors = F.when(t.ok, t.col).otherwise(value), F.when(t.ok, F.array().cast(ERRORS)).otherwise(errors)
            return F.struct(value.alias("value"), F.when(gone, F.array().cast(ERRORS)).otherwise(errors).alias("errors"), gone.alias("gone"))

        if len(self.items) == 1 and not self.dropped and not self.distinct and self._checks(of, inner):
            # items stay as they are: one boolean pass, and details only where an item fails
            bad = F.exists(v.col, lambda c: ~self.items[0].guarded(Value(c, of), inner).ok)
            told = F.flatten(F.transform(v.col, lambda c, i: one(c, i)["errors"]))
            return replace(v, lists=[*v.lists, F.when(bad, told).otherwise(F.array().cast(ERRORS))])
        done = ctx.bind(replace(v, col=F.transform(v.col, one)))
        lists = F.flatten(F.transform(done.col, lambda x: x["errors"]))
        kept = F.filter(done.col, lambda x: ~x["gone"]) if self.dropped else done.col
        value = F.transform(kept, lambda x: x["value"])
        return replace(done, col=F.array_distinct(value) if self.distinct else value, type=T.ArrayType(kind), lists=[*v.lists, lists])


class ExactSequence(Node):
    """As many items as contracts, each at its place."""

    def __init__(self, items: list, msg: str | None = None):
        self.items, self.msg = [node(x) for x in items], msg

    def lower(self, v: Value, ctx: Context) -> Value:
        if not isinstance(v.type, T.ArrayType):
            return replace(v, errors=[*v.errors, v.failed(F.lit(True), "exact_sequence", self.msg or "expected_sequence_of_items")])
        wrong = F.size(v.col) != len(self.items)
        errors = [*v.errors, v.failed(wrong, "exact_sequence", self.msg or "expected_sequence_of_items")]
        inner = ctx.inside()
        made = [x.guarded(Value(F.get(v.col, F.lit(i)), v.type.elementType, [*v.path, F.lit(f"[{i}]")]), inner) for i, x in enumerate(self.items)]
        errors += [F.when(~wrong, e) for m in made for e in m.errors]
        lists = [F.when(~wrong, e).otherwise(F.array().cast(ERRORS)) for m in made for e in m.lists]
        kind = made[0].type if made else v.type.elementType
        return replace(v, col=F.array(*[m.col for m in made]) if made else v.col, type=T.ArrayType(kind), errors=errors, lists=[*v.lists, *lists])


class Unordered(Node):
    """A one-to-one match of items and contracts in any order, first fit; the value stays as it is."""

    def __init__(self, items: list, msg: str | None = None):
        self.items, self.msg = [node(x) for x in items], msg

    def lower(self, v: Value, ctx: Context) -> Value:
        if not isinstance(v.type, T.ArrayType):
            return replace(v, errors=[*v.errors, v.failed(F.lit(True), "not_a_sequence", self.msg or "expected_sequence")])
        inner, n = ctx.inside(), len(self.items)

        def take(used: Column, c: Column) -> Column:
            """The bit set of contracts in use; -1 once an item matches none that is free."""
            fits = [x.guarded(Value(c, v.type.elementType), inner).ok for x in self.items]
            out = F.lit(-1).cast("long")
            for i in reversed(range(n)):
                bit = F.lit(1 << i).cast("long")
                out = F.when((used >= 0) & (used.bitwiseAND(bit) == 0) & fits[i], used.bitwiseOR(bit)).otherwise(out)
            return out

        used = F.aggregate(v.col, F.lit(0).cast("long"), take)
        return replace(v, errors=[*v.errors, v.failed((F.size(v.col) != n) | (used < 0), "value", self.msg or "element_not_valid")])
