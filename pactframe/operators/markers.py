"""Markers of keys: what presence and absence mean."""

from __future__ import annotations

from typing import Any

from pactframe.plans.nodes import SchemaError

UNDEFINED = type("Undefined", (), {"__repr__": lambda self: "UNDEFINED", "__bool__": lambda self: False})()


class Marker:
    """A key with a role. Equal to another marker of the same key, so that contracts can be merged."""

    required = False

    def __init__(self, key: Any, msg: str | None = None, description: str | None = None, default: Any = UNDEFINED):
        if isinstance(key, Marker):
            if not isinstance(key, Secret) and not isinstance(self, Secret):
                raise SchemaError(f"two markers on one key: {key.key!r}")
            self.inner, key = key, key.key
        self.key, self.msg, self.description = key, msg, description
        self._default = default

    def default(self) -> Any:
        return self._default() if callable(self._default) else self._default

    def names(self) -> list[str]:
        return [self.key]

    def __hash__(self) -> int:
        return hash(self.key)

    def __eq__(self, other: object) -> bool:
        return self.key == (other.key if isinstance(other, Marker) else other)

    def __repr__(self) -> str:
        return f"{type(self).__name__}({self.key!r})"


class Optional(Marker):
    """May be absent; a default fills in."""

    def __init__(self, key, default: Any = UNDEFINED, msg=None, description=None):
        super().__init__(key, msg, description, default)


class Required(Optional):
    """Must be present, unless a default fills in. The key may be ``Any`` of several: then one of them must be."""

    required = True


class Alias(Marker):
    """A key under several names: the first that is present counts, the key's own name leading if it is accepted."""

    def __init__(self, key, *aliases: str, accept_canonical: bool = True, required: bool = False, default: Any = UNDEFINED, msg=None, description=None):
        super().__init__(key, msg, description, default)
        if not aliases:
            raise SchemaError("an alias needs another name")
        self.aliases, self.accept_canonical, self.required = list(aliases), accept_canonical, required

    def names(self) -> list[str]:
        return [self.key, *self.aliases] if self.accept_canonical else self.aliases


class Inclusive(Marker):
    """All keys of a group or none."""

    def __init__(self, key, group: str, msg=None, description=None, default: Any = UNDEFINED):
        super().__init__(key, msg, description, default)
        self.group = group


class Exclusive(Marker):
    """At most one key of a group; exactly one if required."""

    def __init__(self, key, group: str, msg=None, description=None, required: bool = False, default: Any = UNDEFINED):
        super().__init__(key, msg, description, default)
        self.group, self.one = group, required


class Forbidden(Marker):
    """Presence is an error."""


class Remove(Marker):
    """Dropped if its value is valid."""


class Secret(Marker):
    """Errors of this key are marked by their key ``secret``: nothing of the value is told. Wraps another marker or a name."""


class _Extra(Marker):
    """All other keys."""

    def __init__(self):
        super().__init__("<extra>")


Extra = _Extra()
