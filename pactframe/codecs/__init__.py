"""Contracts from and to other forms: JSON Schema, Spark schemas, annotated classes. All of it runs on the driver."""

from pactframe.codecs.annotations import Key, contract_of
from pactframe.codecs.fields import to_field_list
from pactframe.codecs.jsonschema import from_json_schema, from_openapi, to_json_schema, to_openapi

__all__ = ["Key", "contract_of", "from_json_schema", "from_openapi", "to_field_list", "to_json_schema", "to_openapi"]
