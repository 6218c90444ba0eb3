"""Contracts of dataclasses and TypedDicts, from their annotations."""

from __future__ import annotations

import dataclasses
import types
import typing
from dataclasses import dataclass

from pactframe.contract import Contract
from pactframe.functions import In
from pactframe.operators.combinators import All, Any, Maybe
from pactframe.operators.mapping import Mapping
from pactframe.operators.markers import Alias, Exclusive, Forbidden, Inclusive, Marker, Optional, Remove, Required, Secret
from pactframe.plans.nodes import Node, SchemaError, Self, node


@dataclass(frozen=True)
class Key:
    """What ``Annotated`` may say of a field's key: one role at most, secrecy, presence, and the policy for extra keys of what is nested in it."""

    secret: bool = False
    alias: str | tuple[str, ...] | None = None
    accept_canonical: bool = True
    forbidden: bool = False
    remove: bool = False
    inclusive: str | None = None
    exclusive: str | None = None
    required: bool | None = None
    description: str | None = None
    msg: str | None = None
    extra: int | None = None

    def marker(self, name: str, required: bool, given: dict) -> Marker:
        if sum(map(bool, (self.alias, self.forbidden, self.remove, self.inclusive, self.exclusive))) > 1:
            raise SchemaError(f"several roles for {name!r}")
        told = {"msg": self.msg, "description": self.description}
        must = required if self.required is None else self.required
        if self.alias:
            made = Alias(name, *((self.alias,) if isinstance(self.alias, str) else self.alias), accept_canonical=self.accept_canonical, required=must, **told, **given)
        elif self.forbidden or self.remove:
            made = (Forbidden if self.forbidden else Remove)(name, **told)
        elif self.inclusive:
            made = Inclusive(name, self.inclusive, **told, **given)
        elif self.exclusive:
            made = Exclusive(name, self.exclusive, **told, **given)
        else:
            made = (Required if must else Optional)(name, **told, **({} if self.required else given))
        return Secret(made) if self.secret else made


def contract_of(cls: type, constraints: dict | None = None, extra: int = 0) -> Contract:
    """A field without a default is required. ``constraints`` add to fields by name, after their types."""
    if not dataclasses.is_dataclass(cls) and not typing.is_typeddict(cls):
        raise SchemaError(f"{cls!r} is neither a dataclass nor a TypedDict")
    return Contract(_fields(cls, constraints or {}, ()), extra=extra)


def _fields(cls: type, constraints: dict, above: tuple) -> dict:
    hints, out = typing.get_type_hints(cls, include_extras=True), {}
    if dataclasses.is_dataclass(cls):
        defaults = {}
        for f in dataclasses.fields(cls):
            if f.default is not dataclasses.MISSING:
                defaults[f.name] = f.default
            elif f.default_factory is not dataclasses.MISSING:
                defaults[f.name] = f.default_factory
        names = [f.name for f in dataclasses.fields(cls) if f.init]
        required = [n for n in names if n not in defaults]
    else:
        defaults, names, required = {}, list(hints), cls.__required_keys__
    for n in names:
        inner = _node(hints[n], (*above, cls))
        more = constraints.get(n)
        value = All(inner, node(more)) if more is not None else inner
        # a default of None is what an absent field is already
        given = {"default": defaults[n]} if n in defaults and defaults[n] is not None else {}
        key = next((a for a in getattr(hints[n], "__metadata__", ()) if isinstance(a, Key)), Key())
        if key.extra is not None and isinstance(value, Mapping):
            value = Mapping(value.schema, value.required, key.extra)
        out[key.marker(n, n in required, given)] = value
    return out


def _node(hint, above: tuple) -> Node:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if isinstance(hint, typing.NewType):
        return _node(hint.__supertype__, above)
    if hint is typing.Any:
        return node(object)
    if origin in (typing.Required, typing.NotRequired):
        return _node(args[0], above)
    if origin is typing.Annotated:
        rules = [node(a) for a in args[1:] if not isinstance(a, Key) and (isinstance(a, Node) or callable(a))]
        return All(_node(args[0], above), *rules) if rules else _node(args[0], above)
    if origin is typing.Literal:
        return In(list(args))
    if origin in (typing.Union, types.UnionType):
        some = [_node(a, above) for a in args if a is not type(None)]
        made = some[0] if len(some) == 1 else Any(*some)
        return Maybe(made) if type(None) in args else made
    if origin in (list, set, frozenset) or origin is tuple and len(args) == 2 and args[1] is Ellipsis or getattr(origin, "__name__", "") in ("Sequence", "MutableSequence"):
        inner = [_node(args[0], above)] if args else [node(object)]
        return node(set(inner) if origin in (set, frozenset) else inner)
    if origin is tuple:
        from pactframe.operators.sequence import ExactSequence

        return ExactSequence([_node(a, above) for a in args])
    if origin is dict or getattr(origin, "__name__", "") in ("Mapping", "MutableMapping"):
        return node({_node(args[0], above): _node(args[1], above)})
    if isinstance(hint, type) and hint in above:
        if hint is not above[0]:
            raise SchemaError(f"{hint.__name__} holds itself below the contract's root")
        return Self
    if isinstance(hint, type) and (dataclasses.is_dataclass(hint) or typing.is_typeddict(hint)):
        return node(_fields(hint, {}, above))
    return node(hint)
