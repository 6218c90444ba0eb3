"""JSON Schema and OpenAPI schema objects.

Decoding is strict: a keyword that would narrow the schema and has no contract is refused, as are references, nesting beyond ``DEPTH`` and malformed
documents. Declared properties close an object unless ``additionalProperties`` opens it. Encoding leaves out what JSON Schema can't say, or refuses
it with ``strict``.
"""

from __future__ import annotations

from dataclasses import replace
from typing import Any as Anything

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactframe import functions as f
from pactframe.contract import Contract
from pactframe.operators.combinators import All, Any, Maybe, Msg, SomeOf, TaggedUnion
from pactframe.operators.mapping import ALLOW_EXTRA, PREVENT_EXTRA, Mapping
from pactframe.operators.markers import UNDEFINED, Alias, Exclusive, Forbidden, Inclusive, Optional, Required
from pactframe.operators.sequence import ExactSequence, Sequence
from pactframe.plans.nodes import Check, Context, EnumNode, LiteralNode, Node, SchemaError, Self, Transform, TypeNode, Value, integral, node, numeric

DEPTH = 100
# Keywords that narrow a schema and that contracts can't express.
REFUSED = {"if", "propertyNames", "patternProperties", "dependentSchemas", "dependencies", "unevaluatedProperties", "unevaluatedItems", "$dynamicRef", "$recursiveRef"}
FORMATS = {"email": f.Email, "uri": f.Url, "url": f.Url, "date-time": f.AsDatetime, "date": f.Date, "time": f.Time, "ipv4": f.IPv4Address, "ipv6": f.IPv6Address, "uuid": f.UUID, "hostname": f.Hostname, "byte": f.Base64}
FORMAT_OF = {"expected_email_address": "email", "expected_url": "uri", "Date": "date", "Time": "time", "expected_ipv4": "ipv4", "IPv6Address": "ipv6", "UUID": "uuid", "Hostname": "hostname", "AsDatetime": "date-time", "AsDate": "date"}


class Not(Node):
    """What the inner contract rejects."""

    def __init__(self, inner):
        self.inner = node(inner)

    def lower(self, v: Value, ctx: Context) -> Value:
        return replace(v, errors=[*v.errors, v.failed(self.inner.lower(v.fresh(), ctx).ok, "not_valid", "not_a_valid_value")])


class JsonType(Node):
    """A type by JSON's rules: booleans aren't numbers, whole floats are integers."""

    def __init__(self, name: str):
        self.name = name

    def takes_null(self) -> bool:
        return self.name == "null"

    def lower(self, v: Value, ctx: Context) -> Value:
        t, floating = v.type, isinstance(v.type, (T.DoubleType, T.FloatType))
        fits = {"string": isinstance(t, T.StringType), "boolean": isinstance(t, T.BooleanType), "number": numeric(t), "integer": integral(t) or numeric(t), "array": isinstance(t, T.ArrayType), "object": isinstance(t, (T.StructType, T.MapType)), "null": True}[self.name]
        bad = F.lit(not fits)
        if self.name == "integer" and fits and not integral(t):
            bad = (v.col != F.floor(v.col)) | F.isnan(v.col) if floating else v.col != F.floor(v.col)
        if self.name == "null":
            bad = v.col.isNotNull()
        return replace(v, errors=[*v.errors, v.failed(F.coalesce(bad, F.lit(True)), "type", "expected_type")])


def from_json_schema(doc: dict) -> Contract:
    """A contract of an object schema."""
    made = _decode(_inlined(doc, doc, ()), 0)
    # what is said of the row besides its keys is held against it as a whole
    parts = made.branches if isinstance(made, All) else [made]
    made = next((b for b in parts if isinstance(b, Mapping)), None)
    if made is None:
        raise SchemaError("the schema of a row is an object")
    out = Contract({})
    out.root = made
    made.bound = True
    out.also = [b for b in parts if b is not made]
    return out


def from_openapi(doc: dict) -> Contract:
    """Like ``from_json_schema``, with ``nullable``."""
    return from_json_schema(doc)


def _inlined(doc: Anything, root: dict, above: tuple[str, ...]) -> Anything:
    """``doc`` with what local references point to in their place. One to the whole document stays, others mustn't lead back to themselves."""
    if isinstance(doc, list):
        return [_inlined(x, root, above) for x in doc]
    if not isinstance(doc, dict):
        return doc
    ref = doc.get("$ref")
    if not isinstance(ref, str) or ref == "#":
        return {k: x if k in ("const", "enum", "default") else _inlined(x, root, above) for k, x in doc.items() if k not in ("$defs", "definitions")}
    if ref in above or len(above) > DEPTH:
        raise SchemaError(f"only the whole document may hold itself: {ref}")
    target: Anything = root
    for part in ref.removeprefix("#/").split("/") if ref.startswith("#/") else [None]:
        part = part and part.replace("~1", "/").replace("~0", "~")
        if not isinstance(target, dict) or part not in target:
            raise SchemaError(f"nothing at {ref}")
        target = target[part]
    target = _inlined(target, root, (*above, ref))
    others = _inlined({k: x for k, x in doc.items() if k != "$ref"}, root, above)
    return {"allOf": [target, others]} if others else target


def _decode(doc: Anything, depth: int) -> Node:
    if depth > DEPTH:
        raise SchemaError("nested too deeply")
    if doc is True or doc == {}:
        return TypeNode(object)
    if doc is False:
        return Not(object)
    if not isinstance(doc, dict):
        raise SchemaError(f"no schema: {doc!r}")
    if doc.get("$ref") == "#":
        if len(doc) > 1:
            raise SchemaError("a reference to the whole document stands alone")
        return Self
    if refused := REFUSED & doc.keys():
        raise SchemaError(f"not supported: {sorted(refused)}")
    parts: list[Node] = []
    if "const" in doc:
        parts.append(_literal(doc["const"]))
    elif "enum" in doc:
        if not isinstance(doc["enum"], list) or not doc["enum"]:
            raise SchemaError("an enumeration needs values")
        parts.append(Any(*map(_literal, doc["enum"])))
    if "not" in doc:
        parts.append(Not(_decode(doc["not"], depth + 1)))
    for word, make in (("allOf", lambda b: All(*b)), ("anyOf", lambda b: Any(*b)), ("oneOf", lambda b: SomeOf(b, min_valid=1, max_valid=1))):
        if word in doc:
            if not isinstance(doc[word], list) or not doc[word]:
                raise SchemaError(f"{word} needs schemas")
            parts.append(make([_decode(b, depth + 1) for b in doc[word]]))
    kinds = doc.get("type")
    if isinstance(kinds, list):
        parts.append(Any(*[_typed(doc | {"type": k}, k, depth) for k in kinds]))
    elif kinds is not None or _implied(doc):
        parts.append(_typed(doc, kinds or _implied(doc), depth))
    made = parts[0] if len(parts) == 1 else All(*parts) if parts else TypeNode(object)
    return Maybe(made) if doc.get("nullable") is True else made


def _literal(value: Anything) -> Node:
    if isinstance(value, (dict, list)):
        raise SchemaError("only plain constants are supported")
    return LiteralNode(value)


def _implied(doc: dict) -> str | None:
    for kind, words in (("object", ("properties", "required", "additionalProperties")), ("array", ("items", "prefixItems", "minItems", "maxItems", "uniqueItems", "contains")), ("string", ("pattern", "minLength", "maxLength", "format")), ("number", ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"))):
        if any(w in doc for w in words):
            return kind
    return None


def _number(doc: dict, word: str, kinds=(int, float)):
    x = doc.get(word)
    if x is not None and (isinstance(x, bool) or not isinstance(x, kinds)):
        raise SchemaError(f"{word} must be a number")
    return x


def _typed(doc: dict, kind: str, depth: int) -> Node:
    if kind not in ("string", "boolean", "number", "integer", "array", "object", "null"):
        raise SchemaError(f"unknown type {kind!r}")
    if kind == "object":
        return _object(doc, depth)
    parts: list[Node] = [JsonType(kind)]
    if kind == "string":
        if "minLength" in doc or "maxLength" in doc:
            parts.append(f.Length(_number(doc, "minLength", int), _number(doc, "maxLength", int)))
        if "pattern" in doc:
            if is_catastrophic(doc["pattern"]):
                raise SchemaError("the pattern may take exponential time")
            parts.append(f.Match(f"(?s:.*?)(?:{doc['pattern']})"))
        if doc.get("contentEncoding") == "base64":
            parts.append(f.Base64())
        if doc.get("format") in FORMATS:
            parts.append(FORMATS[doc["format"]]())
    if kind in ("number", "integer"):
        low, high = _number(doc, "minimum"), _number(doc, "maximum")
        for word, bound in (("exclusiveMinimum", low), ("exclusiveMaximum", high)):
            x = doc.get(word)
            if x is True:
                if bound is None:
                    raise SchemaError(f"{word} needs its bound")
                parts.append(f.Range(min=bound, min_included=False) if word == "exclusiveMinimum" else f.Range(max=bound, max_included=False))
            elif x is not None and x is not False:
                x = _number(doc, word)
                parts.append(f.Range(min=x, min_included=False) if word == "exclusiveMinimum" else f.Range(max=x, max_included=False))
        if low is not None or high is not None:
            parts.append(f.Range(low, high))
        if "multipleOf" in doc:
            parts.append(f.MultipleOf(_number(doc, "multipleOf", int)))
    if kind == "array":
        if "prefixItems" in doc:
            parts.append(ExactSequence([_decode(x, depth + 1) for x in doc["prefixItems"]]))
        elif "items" in doc:
            parts.append(Sequence([_decode(doc["items"], depth + 1)]))
        if "minItems" in doc or "maxItems" in doc:
            parts.append(f.Length(_number(doc, "minItems", int), _number(doc, "maxItems", int)))
        if doc.get("uniqueItems"):
            parts.append(f.Unique())
        if "contains" in doc:
            parts.append(_contains(_decode(doc["contains"], depth + 1), doc.get("minContains", 1), doc.get("maxContains")))
    return parts[0] if len(parts) == 1 else All(*parts)


def _contains(inner: Node, least: int, most: int | None) -> Node:
    def test(c, t):
        if not isinstance(t, T.ArrayType):
            return F.lit(False)
        n = F.size(F.filter(c, lambda x: inner.guarded(Value(x, t.elementType), Context(inline=True)).ok))
        return (n >= least) & (n <= most) if most is not None else n >= least

    return Check("contains", test, {}, "contains", "value_must_contain", None)


def _object(doc: dict, depth: int) -> Node:
    properties, required = doc.get("properties", {}), doc.get("required", [])
    if not isinstance(properties, dict) or not isinstance(required, list):
        raise SchemaError("malformed object")
    fields: dict = {}
    for k, sub in properties.items():
        if sub is False:
            fields[Forbidden(k)] = object
            continue
        default = sub.get("default", UNDEFINED) if isinstance(sub, dict) else UNDEFINED
        fields[(Required if k in required else Optional)(k, default=default)] = _decode(sub, depth + 1)
    for k in required:
        if k not in properties:
            fields[Required(k)] = object
    more = doc.get("additionalProperties", not properties)
    if isinstance(more, dict):
        if not properties:
            return Mapping({str: _decode(more, depth + 1)})
        from pactframe.operators.markers import Extra

        fields[Extra] = _decode(more, depth + 1)
    return Mapping(fields, extra=ALLOW_EXTRA if more is True else PREVENT_EXTRA)


def is_catastrophic(pattern: str) -> bool:
    """Whether a repeated group holds a repetition or alternatives that begin alike: such patterns may backtrack without end."""
    import re
    from re import _constants as c
    from re import _parser as p

    try:
        tree = p.parse(pattern)
    except (re.error, TypeError) as e:
        raise SchemaError(f"bad pattern: {e}") from None
    repeats = (c.MAX_REPEAT, c.MIN_REPEAT)

    def inner(items, looped: bool) -> bool:
        for op, arg in items:
            if op in repeats:
                many = arg[1] is c.MAXREPEAT or arg[1] > 32
                if looped and many or inner(arg[2], looped or many):
                    return True
            elif op is c.BRANCH:
                if looped and len({str(list(b)[:1]) for b in arg[1]}) < len(arg[1]) or any(inner(b, looped) for b in arg[1]):
                    return True
            elif op is c.SUBPATTERN and inner(arg[3], looped):
                return True
        return False

    return inner(tree, False)


def to_json_schema(contract: Contract | Node, strict: bool = False) -> dict:
    """The document of a contract."""
    return _document(contract, strict, "2020")


def to_openapi(contract: Contract | Node, openapi_version: str = "3.1.0", strict: bool = False) -> dict:
    """A schema object; 3.0 has ``nullable`` and boolean exclusive bounds."""
    return _document(contract, strict, "3.0" if openapi_version.startswith("3.0") else "2020")


def _document(contract: Contract | Node, strict: bool, dialect: str) -> dict:
    if not isinstance(contract, Contract):
        return _encode(node(contract), strict, dialect)
    out = _encode(contract.root, strict, dialect)
    return out | {"allOf": [*out.get("allOf", []), *[_encode(n, strict, dialect) for n in contract.also]]} if contract.also else out


def _encode(n: Node, strict: bool, dialect: str) -> dict:
    def sub(x):
        return _encode(x, strict, dialect)

    if isinstance(n, Mapping):
        return _encode_object(n, strict, dialect)
    if n is Self:
        return {"$ref": "#"}
    if isinstance(n, TypeNode):
        name = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array", dict: "object"}.get(n.kind)
        return {"type": name} if name else {}
    if isinstance(n, JsonType):
        return {"type": n.name}
    if isinstance(n, LiteralNode):
        return {"type": "null"} if n.value is None else {"const": n.value} if dialect != "3.0" else {"enum": [n.value]}
    if isinstance(n, EnumNode):
        return {"enum": [m.value for m in n.kind]}
    if isinstance(n, Sequence):
        items = [sub(x) for x in n.items]
        return {"type": "array", "maxItems": 0} if not items else {"type": "array", "items": items[0] if len(items) == 1 else {"anyOf": items}}
    if isinstance(n, ExactSequence):
        k = len(n.items)
        return {"type": "array", "minItems": k, "maxItems": k} | ({"prefixItems": [sub(x) for x in n.items]} if dialect != "3.0" else {})
    if isinstance(n, All):
        out: dict = {}
        for b in map(sub, n.branches):
            if out.keys() & b.keys():
                return {"allOf": [sub(x) for x in n.branches]}
            out |= b
        return out
    if isinstance(n, Any):
        return {"enum": [b.value for b in n.branches]} if all(isinstance(b, LiteralNode) for b in n.branches) else {"anyOf": [sub(b) for b in n.branches]}
    if isinstance(n, Maybe):
        inner = sub(n.inner)
        return inner | {"nullable": True} if dialect == "3.0" else {"anyOf": [inner, {"type": "null"}]}
    if isinstance(n, TaggedUnion):
        return {"oneOf": [sub(c) for c in n.cases.values()]}
    if isinstance(n, SomeOf):
        return {"oneOf" if (n.low, n.high) == (1, 1) else "allOf" if n.low == len(n.branches) else "anyOf": [sub(b) for b in n.branches]} if n.low else {}
    if isinstance(n, Not):
        return {"not": sub(n.inner)}
    if isinstance(n, Msg):
        return sub(n.inner)
    if isinstance(n, (Check, Transform)):
        got = _encode_rule(n, dialect)
        if got is not None:
            return got
    if strict:
        raise SchemaError(f"no JSON Schema for {n!r}")
    return {}


def _encode_rule(n: Check | Transform, dialect: str) -> dict | None:
    p = n.params
    if n.name == "Range":
        out: dict = {}
        for bound, closed, word in (("min", "min_included", "inimum"), ("max", "max_included", "aximum")):
            if p[bound] is not None:
                name, exclusive = bound[0] + word, f"exclusive{bound[0].upper()}{word}"
                out |= {name: p[bound]} if p[closed] else {name: p[bound], exclusive: True} if dialect == "3.0" else {exclusive: p[bound]}
        return out
    if n.name == "Length":
        return {k: v for k, v in (("minLength", p["min"]), ("maxLength", p["max"])) if v is not None}
    if n.name == "In":
        return {"enum": list(p["container"])}
    if n.name == "NotIn":
        return {"not": {"enum": list(p["container"])}}
    if n.name == "Equal":
        return {"const": p["target"]}
    if n.name == "MultipleOf":
        return {"multipleOf": p["factor"]}
    if n.name == "Match":
        return {"pattern": f"^(?:{p['pattern']})"}
    if n.name == "Unique":
        return {"uniqueItems": True}
    if n.name == "NonEmpty":
        return {"minLength": 1}
    if n.name == "Coerce":
        return _encode(TypeNode(p["type"]), False, dialect) if p["type"] in (int, float, str, bool) else None
    if n.name == "Boolean":
        return {"type": "boolean"}
    if n.name == "expected_base64_string":
        return {"type": "string", "contentEncoding": "base64"}
    if n.name in FORMAT_OF:
        return {"type": "string", "format": FORMAT_OF[n.name]}
    return None


def _encode_object(n: Mapping, strict: bool, dialect: str) -> dict:
    properties, required, groups, rules = {}, [], {}, []
    for marker, value, secret in n.fields:
        if isinstance(marker, Forbidden):
            properties[marker.key] = False if dialect != "3.0" else {"not": {}}
            continue
        several = Mapping._several(marker)
        made = _encode(value, strict, dialect)
        if marker.default() is not UNDEFINED:
            made = made | {"default": marker.default()}
        elif marker.required and not several and not isinstance(marker, Alias):
            required.append(marker.key)
        if marker.description:
            made = made | {"description": marker.description}
        for k in several or marker.names():
            properties[k] = made | ({"writeOnly": True} if secret else {})
        if several or isinstance(marker, Alias) and marker.required:
            rules.append({"anyOf": [{"required": [k]} for k in several or marker.names()]})
        if isinstance(marker, (Inclusive, Exclusive)):
            groups.setdefault((type(marker), marker.group), []).append(marker)
    dependent: dict = {}
    for (kind, _), markers in groups.items():
        names = [m.key for m in markers]
        if kind is Inclusive:
            if dialect == "3.0":
                rules.append({"anyOf": [{"required": names}, {"not": {"anyOf": [{"required": [k]} for k in names]}}]})
            else:
                dependent |= {k: [x for x in names if x != k] for k in names}
        else:
            pairs = [{"not": {"required": [a, b]}} for i, a in enumerate(names) for b in names[i + 1 :]]
            rules += pairs
            if any(m.one for m in markers):
                rules.append({"anyOf": [{"required": [k]} for k in names]})
    more = _encode(n.extra_node or n.typed[1], strict, dialect) if n.extra_node or n.typed else n.extra == ALLOW_EXTRA
    out = {"type": "object", "properties": properties, "additionalProperties": more}
    return out | ({"required": required} if required else {}) | ({"dependentRequired": dependent} if dependent else {}) | ({"allOf": rules} if rules else {})
