"""Declarative data contracts for DataFrames: normalised columns and structured errors, as Catalyst expressions."""

from pactframe.contract import ALLOW_EXTRA, PREVENT_EXTRA, REMOVE_EXTRA, Contract
from pactframe.plans.nodes import SchemaError, Self

__all__ = ["ALLOW_EXTRA", "PREVENT_EXTRA", "REMOVE_EXTRA", "Contract", "SchemaError", "Self"]
