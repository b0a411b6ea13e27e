"""Row validation as Column expressions, then one split into valid/quarantine.

Every rule is a boolean Column; the messages of the failing rules are joined
``"field: msg; field: msg"`` in field order. Parsing happens once per row in
codegen'd expressions — no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillrec.functions.dates import parts_to_timestamp, timestamp_parts
from tillrec.functions.enums import in_enum, normalise
from tillrec.functions.money import MONEY, is_optional_blank, parse_money
from tillrec.functions.text import py_strip
from tillrec.session import compiled_code
from tillrec.sources.spec import FieldRule, SourceSpec

# FIXED VALUES: error wording (ours), "field: message".
MSG_REQUIRED = "field required"
MSG_EMPTY = "should have at least 1 character"
MSG_DATETIME = "cannot parse datetime"
MSG_NUMERIC = "must be numeric"
MSG_NEGATIVE = "must be >= 0"
MSG_ENUM = "not an allowed value"
MSG_INT_RANGE = "must be an integer between {lo} and {hi}"
MSG_NET_GT_GROSS = "root: net_value cannot exceed gross_value"
MSG_MALFORMED = "row: malformed line"
MSG_NOT_TEXT = "should be a valid string"
CORRUPT_COL = "_corrupt"

INT_TEXT = r"^\s*[+-]?\d+(\.0+)?\s*$"
ERROR_COL = "validation_error"
ROW_COL = "source_row_index"
#: set by file sources: rows without any value count as read, but are neither valid nor quarantined
BLANK_COL = "_blank_row"


def _err(cond: Column, name: str, msg: str) -> Column:
    return F.when(cond, F.lit(f"{name}: {msg}"))


def _raw(name: str) -> Column:
    return F.col(f"raw_{name}")


def _value(rule: FieldRule, present: bool) -> Column:
    """Typed value of a field, from stage-1 columns (``raw_<f>``, ``parts_<f>``)."""
    name = rule.name
    if not present:
        if rule.default is None:
            return F.lit(None).cast({"money": MONEY, "opt_money": MONEY, "int_range": "int",
                                     "datetime": "timestamp_ntz"}.get(rule.kind, "string"))
        return F.lit(rule.default).cast({"money": MONEY, "opt_money": MONEY,
                                         "int_range": "int"}.get(rule.kind, "string"))
    raw = _raw(name)
    if rule.kind in ("req_str", "opt_str"):
        return raw
    if rule.kind == "datetime":
        return parts_to_timestamp(F.col(f"parts_{name}"))
    if rule.kind == "money":
        v = parse_money(raw)
        if rule.blank_is_null:
            v = F.when(raw.isNull() | (py_strip(raw) == ""), F.lit(None).cast(MONEY)).otherwise(v)
        return v
    if rule.kind == "opt_money":
        return F.when(is_optional_blank(raw), F.lit(None).cast(MONEY)).otherwise(parse_money(raw))
    if rule.kind == "enum":
        return normalise(raw, rule.mapping)
    if rule.kind == "int_range":
        lo, hi = rule.bounds
        ok_text = raw.rlike(INT_TEXT)
        n = F.when(ok_text, F.trim(raw).cast("decimal(38,0)"))
        return F.when(ok_text & n.between(lo, hi), n.cast("int"))
    raise ValueError(f"unknown rule kind {rule.kind}")


def _errors(rule: FieldRule, present: bool, legacy_nan: bool = False) -> list[Column]:
    """Error messages of a field, from the typed value ``<f>`` and the raw text ``raw_<f>``.

    ``legacy_nan`` reproduces how blank cells behaved in the original reader:
    a blank required number was NaN and passed its checks (it is filled with 0
    later), while a blank optional text cell was NaN and failed as "not a string".
    """
    name = rule.name
    if not present:
        if rule.default is None and rule.kind in ("req_str", "datetime", "money", "enum", "int_range"):
            return [F.lit(f"{name}: {MSG_REQUIRED}")]
        return []
    raw, v = _raw(name), F.col(name)
    missing = raw.isNull()
    if rule.kind == "req_str":
        return [_err(missing, name, MSG_REQUIRED), _err(F.length(raw) < 1, name, MSG_EMPTY)]
    if rule.kind == "opt_str":
        return [_err(missing, name, MSG_NOT_TEXT)] if legacy_nan else []
    if rule.kind == "datetime":
        return [_err(missing, name, MSG_REQUIRED), _err(~missing & v.isNull(), name, MSG_DATETIME)]
    if rule.kind == "money":
        if legacy_nan and not rule.blank_is_null:
            errs = [_err(~missing & v.isNull(), name, MSG_NUMERIC)]
        elif rule.blank_is_null:
            errs = [_err(~(missing | (py_strip(raw) == "")) & v.isNull(), name, MSG_NUMERIC)]
        else:
            errs = [_err(missing, name, MSG_REQUIRED), _err(~missing & v.isNull(), name, MSG_NUMERIC)]
        if rule.non_negative:
            errs.append(_err(v < 0, name, MSG_NEGATIVE))
        return errs
    if rule.kind == "opt_money":
        return [_err(~is_optional_blank(raw) & v.isNull(), name, MSG_NUMERIC)]
    if rule.kind == "enum":
        return [_err(missing, name, MSG_REQUIRED), _err(~missing & ~in_enum(v, rule.allowed), name, MSG_ENUM)]
    if rule.kind == "int_range":
        lo, hi = rule.bounds
        return [_err(v.isNull(), name, MSG_INT_RANGE.format(lo=lo, hi=hi))]
    raise ValueError(f"unknown rule kind {rule.kind}")


def validate(df: DataFrame, spec: SourceSpec, legacy_nan: bool = False) -> DataFrame:
    """Add typed columns ``<field>``, keep raw text as ``raw_<field>``, add ``validation_error``.

    ``validation_error`` is null for valid rows. Input columns are the
    canonical field names as strings plus ``source_row_index``.

    Three stacked projections: (1) raw text + date parts, (2) typed values,
    (3) error text. Catalyst keeps them apart because the parsed values are
    referenced several times, so each regex/parse runs once per row; code too
    large to be compiled as one method is generated as many.
    """
    compiled_code(df.sparkSession)
    cols = set(df.columns)
    present = {r.name: r.name in cols for r in spec.fields}
    raw_cols = [F.col(r.name).alias(f"raw_{r.name}") for r in spec.fields if present[r.name]]
    parts = [timestamp_parts(F.col(r.name), r.layouts).alias(f"parts_{r.name}")
             for r in spec.fields if r.kind == "datetime" and present[r.name]]
    # order keys of file sources (file, split start) ride along for file-order rules
    carry = [ROW_COL] + [c for c in (CORRUPT_COL, "_file", "_block", BLANK_COL) if c in cols]
    stage1 = df.select(*raw_cols, *parts, *carry)
    raw_names = [f"raw_{r.name}" for r in spec.fields if present[r.name]]
    stage2 = stage1.select(*[_value(r, present[r.name]).alias(r.name) for r in spec.fields],
                           *raw_names, *carry)
    field_errors = [e for r in spec.fields for e in _errors(r, present[r.name], legacy_nan)]
    if CORRUPT_COL in cols:
        field_errors.insert(0, F.when(F.col(CORRUPT_COL).isNotNull(), F.lit(MSG_MALFORMED)))
    joined = F.concat_ws("; ", *field_errors) if field_errors else F.lit("")
    if spec.net_le_gross:
        cross = F.when((joined == "") & (F.col("net_value") > F.col("gross_value") + F.lit("0.01").cast(MONEY)),
                       F.lit(MSG_NET_GT_GROSS))
        joined = F.concat_ws("; ", F.when(joined != "", joined), cross)
    return stage2.select(*spec.field_names, *raw_names, *carry, F.nullif(joined, F.lit("")).alias(ERROR_COL))


def parsed_once(validated: DataFrame) -> DataFrame:
    """A barrier for a single consumer that filters on the errors.

    Catalyst would push the filter below the projections and substitute the whole parse into it, so
    every row would be parsed twice. Filters on generated columns stay above a one-row explode, which
    is part of the same generated code. Several consumers should store the frame instead.
    """
    row = F.struct(*[F.col(c) for c in validated.columns])
    return validated.select(F.explode(F.array(row)).alias("_r")).select("_r.*")


def _no_blanks(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col(BLANK_COL)) if BLANK_COL in validated.columns else validated


def valid_rows(validated: DataFrame, spec: SourceSpec) -> DataFrame:
    order = [c for c in ("_file", "_block") if c in validated.columns]
    return _no_blanks(validated).where(F.col(ERROR_COL).isNull()).select(*spec.field_names, ROW_COL, *order)


def file_order(df: DataFrame) -> F.Column:
    """Row order in the export: (file, split start, position in split) when read from files.

    Spark packs splits into tasks by size, so the generated row id alone does
    not follow the file; the split start does.
    """
    keys = [F.col(c) for c in ("_file", "_block") if c in df.columns]
    return F.struct(*keys, F.col(ROW_COL))


def quarantine_rows(validated: DataFrame, spec: SourceSpec) -> DataFrame:
    """Original text values of the rejected rows, their errors and row index."""
    raw = [c for c in validated.columns if c.startswith("raw_")]
    return _no_blanks(validated).where(F.col(ERROR_COL).isNotNull()).select(
        *[F.col(c).alias(c[4:]) for c in raw], ERROR_COL, ROW_COL)


def quarantine_log(validated: DataFrame, spec: SourceSpec, source: str) -> DataFrame:
    """Rejected rows of a source in the shape shared by all sources: the original values as a map
    (field -> text, fields without a value left out)."""
    q = quarantine_rows(validated, spec)
    fields = [f for f in spec.field_names if f in q.columns]
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in fields])
    values = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    record = F.col(spec.id_field) if spec.id_field in q.columns else F.lit(None).cast("string")
    return q.select(F.lit(source).alias("source"), record.alias("record_id"), values.alias("original"), ERROR_COL, ROW_COL)


def counts(validated: DataFrame, source: str) -> DataFrame:
    """raw / valid / quarantined counts of one source in one pass; blank rows are raw rows only."""
    blank = F.col(BLANK_COL) if BLANK_COL in validated.columns else F.lit(False)
    return validated.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(~blank & F.col(ERROR_COL).isNull()).alias("valid_rows"),
        F.count_if(~blank & F.col(ERROR_COL).isNotNull()).alias("quarantined_rows"),
    ).select(F.lit(source).alias("source"), "*")
