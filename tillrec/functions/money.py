"""pt-BR money parsing as Column expressions.

Money is ``decimal(18,2)`` end to end; rates are ``decimal(5,4)`` so products
are exact decimals rounded HALF_UP once.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillrec.constants import OPTIONAL_MONEY_NULL_WORDS
from tillrec.functions.text import py_strip

MONEY = "decimal(18,2)"
RATE = "decimal(5,4)"


def rate_lit(rate: Decimal | float | str) -> Column:
    return F.lit(str(rate)).cast(RATE)


def money_text(raw: Column, locale: str = "pt_BR") -> Column:
    """Canonical numeric text for a money cell.

    pt_BR: drop ``R$``, drop every ``.``, turn ``,`` into ``.``, strip — so
    ``1.234,56`` -> ``1234.56`` and (as in the source exports) ``1234.56`` ->
    ``123456``. ``locale="C"`` keeps dots as decimal points.
    """
    no_symbol = F.replace(raw, F.lit("R$"), F.lit(""))
    if locale == "C":
        return py_strip(F.replace(no_symbol, F.lit(","), F.lit("")))
    return py_strip(F.replace(F.replace(no_symbol, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def parse_money(raw: Column, locale: str = "pt_BR") -> Column:
    """Money text -> decimal(18,2) (HALF_UP), null when it is not a number."""
    return money_text(raw, locale).try_cast(MONEY)


def is_optional_blank(raw: Column) -> Column:
    """null, "", "-" and "N/A" mean "no value" for optional money cells."""
    return raw.isNull() | py_strip(raw).isin(*OPTIONAL_MONEY_NULL_WORDS)


def parse_optional_money(raw: Column, locale: str = "pt_BR") -> Column:
    return F.when(is_optional_blank(raw), F.lit(None).cast(MONEY)).otherwise(parse_money(raw, locale))


def round_money(c: Column) -> Column:
    return F.round(c, 2).cast(MONEY)


def cents(amount: Column) -> Column:
    """decimal(18,2) -> integer cents (exact)."""
    return (amount * F.lit(100)).cast("bigint")
