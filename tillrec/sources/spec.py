"""Source specifications: one declarative record per export type.

A new source is a new ``SourceSpec`` — name, delimiters to try, header
aliases and the ordered field rules — with no new code path.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from tillrec.constants import (
    ACQUIRER_PAYMENT_MAP, CIELO_HEADERS, MARKETPLACE_HEADERS, MARKETPLACE_PAYMENT_MAP,
    PAYMENT_METHODS, ORDER_STATUSES, POS_HEADERS, POS_PAYMENT_MAP, SALES_DATE_LAYOUTS,
    SETTLEMENT_DATE_LAYOUTS, STATUS_MAP, STONE_HEADERS,
)


@dataclass(frozen=True)
class FieldRule:
    """How one canonical field is parsed and checked.

    kind: ``req_str`` | ``opt_str`` | ``datetime`` | ``money`` | ``opt_money`` |
    ``enum`` | ``int_range`` | ``const``.
    """

    name: str
    kind: str
    non_negative: bool = False
    layouts: tuple[str, ...] = ()
    mapping: dict[str, str] = field(default_factory=dict)
    allowed: tuple[str, ...] = ()
    bounds: tuple[int, int] = (1, 24)
    default: Any = None
    blank_is_null: bool = False


@dataclass(frozen=True)
class SourceSpec:
    name: str
    delimiters: tuple[str, ...]
    headers: dict[str, str]
    fields: tuple[FieldRule, ...]
    id_field: str
    injected: dict[str, str] = field(default_factory=dict)
    net_le_gross: bool = False

    def with_aliases(self, extra: dict[str, str]) -> "SourceSpec":
        """Caller override of header aliases: ``{**default, **extra}``."""
        return replace(self, headers={**self.headers, **{k.strip().lower(): v for k, v in extra.items()}})

    @property
    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]


MARKETPLACE = SourceSpec(
    name="marketplace",
    delimiters=(";", ","),
    headers=MARKETPLACE_HEADERS,
    id_field="order_id",
    fields=(
        FieldRule("order_id", "req_str"),
        FieldRule("order_date", "datetime", layouts=SALES_DATE_LAYOUTS),
        FieldRule("gross_value", "money", non_negative=True),
        FieldRule("ifood_commission", "opt_money"),
        FieldRule("payment_method", "enum", mapping=MARKETPLACE_PAYMENT_MAP, allowed=PAYMENT_METHODS),
        FieldRule("status", "enum", mapping=STATUS_MAP, allowed=ORDER_STATUSES),
        FieldRule("customer_id", "opt_str"),
        FieldRule("delivery_fee", "opt_money", default="0.00"),
    ),
)

POS = SourceSpec(
    name="pos",
    delimiters=(";", ",", "\t"),
    headers=POS_HEADERS,
    id_field="transaction_id",
    fields=(
        FieldRule("transaction_id", "req_str"),
        FieldRule("transaction_date", "datetime", layouts=SALES_DATE_LAYOUTS),
        FieldRule("gross_value", "money", non_negative=True),
        FieldRule("payment_method", "enum", mapping=POS_PAYMENT_MAP, allowed=PAYMENT_METHODS),
        FieldRule("cashier_id", "opt_str"),
        FieldRule("table_number", "opt_str"),
        FieldRule("notes", "opt_str"),
    ),
)


def acquirer_spec(acquirer_name: str = "stone") -> SourceSpec:
    """Stone headers for ``stone``; every other name gets the Cielo map."""
    name = acquirer_name.lower().strip()
    return SourceSpec(
        name="acquirer",
        delimiters=(";", ","),
        headers=STONE_HEADERS if name == "stone" else CIELO_HEADERS,
        id_field="authorization_code",
        injected={"acquirer_name": name},
        net_le_gross=True,
        fields=(
            FieldRule("authorization_code", "req_str"),
            FieldRule("settlement_date", "datetime", layouts=SETTLEMENT_DATE_LAYOUTS),
            FieldRule("gross_value", "money"),
            FieldRule("net_value", "money"),
            FieldRule("acquirer_fee", "money", default="0.00", blank_is_null=True),
            FieldRule("payment_method", "enum", mapping=ACQUIRER_PAYMENT_MAP, allowed=PAYMENT_METHODS),
            FieldRule("installments", "int_range", bounds=(1, 24), default=1),
            FieldRule("acquirer_name", "req_str", default="stone"),
            FieldRule("nsu", "opt_str"),
        ),
    )


ACQUIRER = acquirer_spec("stone")
