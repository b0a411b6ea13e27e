"""Enum normalisation: per-source spelling maps plus exact allow-lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillrec.functions.text import py_strip


def lookup(key: Column, mapping: Mapping[str, str]) -> Column:
    """mapping[key] as a CASE chain (codegen'd; null when absent)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def normalise(raw: Column, mapping: Mapping[str, str]) -> Column:
    """lower(strip(v)) looked up in ``mapping``; an unmapped value passes through unchanged.

    The pass-through value then has to equal a canonical value exactly, so
    ``outro`` is accepted and ``Outro`` is not.
    """
    return F.coalesce(lookup(F.lower(py_strip(raw)), mapping), raw)


def in_enum(c: Column, allowed: Sequence[str]) -> Column:
    return c.isNotNull() & c.isin(*allowed)
