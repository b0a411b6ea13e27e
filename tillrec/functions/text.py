"""String helpers built from JVM-side expressions (whole-stage codegen safe)."""

from __future__ import annotations

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillrec.constants import HTML_TAG_PATTERN

# Characters Python's str.strip() removes; derived by rule (str.isspace), not listed.
_PY_SPACE = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace the way python's str.strip() does.

    ``F.trim`` only removes ASCII spaces, so tabs, NBSP and line separators
    would survive it; ``btrim`` with the explicit set is a plain scan, no regex. It goes through the whole set for
    the characters at both ends, so a text that begins and ends with visible ASCII, as most do, isn't given to it.
    """
    visible = (c >= F.lit("!")) & (c < F.lit("\x7f")) & F.substring(c, -1, 1).between("!", "~")
    return F.when(visible, c).otherwise(F.btrim(c, F.lit(_PY_SPACE)))


def clean_markup(c: Column) -> Column:
    """Remove HTML tags and NUL characters, then strip."""
    return py_strip(F.regexp_replace(F.regexp_replace(c, HTML_TAG_PATTERN, ""), "\u0000", ""))


def capitalize(c: Column) -> Column:
    """python str.capitalize(): first character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def brl(amount: Column) -> Column:
    """``R$ 1234.56`` — two decimals, no thousands separator (``%.2f``)."""
    return F.concat(F.lit("R$ "), amount.cast("decimal(18,2)").cast("string"))


def brl_grouped(amount: Column) -> Column:
    """``R$ 1,234.56`` — ``{:,.2f}`` layout used in the statement sheet."""
    return F.concat(F.lit("R$ "), F.format_number(amount.cast("decimal(18,2)"), 2))
