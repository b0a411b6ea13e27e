"""Business rates and validated job arguments."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import PurePath

from tillrec.constants import ACQUIRERS, FILE_SUFFIXES, MONTH_PATTERN


def _env_decimal(name: str, default: str) -> Decimal:
    return Decimal(os.environ.get(f"TILLREC_{name.upper()}", default))


@dataclass(frozen=True)
class Rates:
    """Rates that change results. Defaults are the documented contract values.

    ``fee_fallback``: ``"by_method"`` applies the method's rate to pos rows
    without a settlement match (documented behaviour); ``"credit_only"``
    applies the credit rate to every such row, which is what a string-keyed
    lookup of enum members ends up doing in the original service.
    """

    commission_rate: Decimal = Decimal("0.23")
    credit_fee: Decimal = Decimal("0.0299")
    debit_fee: Decimal = Decimal("0.0149")
    pix_fee: Decimal = Decimal("0.0099")
    cash_fee: Decimal = Decimal("0.0")
    gap_tolerance: Decimal = Decimal("0.05")
    fee_fallback: str = "by_method"

    @classmethod
    def from_env(cls) -> "Rates":
        return cls(
            commission_rate=_env_decimal("commission_rate", "0.23"),
            credit_fee=_env_decimal("credit_fee", "0.0299"),
            debit_fee=_env_decimal("debit_fee", "0.0149"),
            pix_fee=_env_decimal("pix_fee", "0.0099"),
            cash_fee=_env_decimal("cash_fee", "0.0"),
            gap_tolerance=_env_decimal("gap_tolerance", "0.05"),
            fee_fallback=os.environ.get("TILLREC_FEE_FALLBACK", "by_method"),
        )

    def fee_by_method(self) -> dict[str, Decimal]:
        """Method -> MDR rate; voucher is charged as debit, outro as credit."""
        if self.fee_fallback == "credit_only":
            return {m: self.credit_fee for m in
                    ("credito", "debito", "pix", "dinheiro", "voucher", "outro")}
        return {
            "credito": self.credit_fee,
            "debito": self.debit_fee,
            "pix": self.pix_fee,
            "dinheiro": self.cash_fee,
            "voucher": self.debit_fee,
            "outro": self.credit_fee,
        }

    @property
    def tolerance_cents(self) -> int:
        return int((self.gap_tolerance * 100).to_integral_value())


@dataclass(frozen=True)
class JobArgs:
    """Arguments of one monthly run; validated on construction."""

    marketplace_path: str
    pos_path: str
    acquirer_path: str
    reference_month: str
    acquirer_name: str = "stone"
    rates: Rates = field(default_factory=Rates)

    def __post_init__(self) -> None:
        if not re.match(MONTH_PATTERN, self.reference_month):
            raise ValueError(f"reference_month must be YYYY-MM; got {self.reference_month!r}")
        name = self.acquirer_name.lower().strip()
        if name not in ACQUIRERS:
            raise ValueError(f"acquirer_name must be one of {sorted(ACQUIRERS)}; got {self.acquirer_name!r}")
        object.__setattr__(self, "acquirer_name", name)
        for p in (self.marketplace_path, self.pos_path, self.acquirer_path):
            check_input_path(p)


def check_input_path(path: str) -> str:
    path = path.strip()
    if ".." in PurePath(path).parts:
        raise ValueError("Path traversal ('..') is not allowed in file paths.")
    suffix = PurePath(path).suffix.lower()
    if suffix == ".xls":
        raise ValueError("Binary .xls workbooks can't be read; save them as .xlsx.")
    if suffix not in FILE_SUFFIXES:
        raise ValueError(f"Unsupported file extension {suffix!r}; allowed {sorted(FILE_SUFFIXES)}")
    return path
