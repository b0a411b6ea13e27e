"""Multi-layout timestamp parsing, time-zone free.

Each accepted layout becomes an anchored regex (what python's strptime
accepts for it: 1- or 2-digit day/month/hour, 4-digit year, runs of blanks,
case-insensitive literals); the captured parts are cast as ISO text, which
yields null for impossible dates such as 31/02. No session time zone is involved, so results do not depend on where
the job runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: what each strptime directive accepts.
_DIRECTIVE = {
    "Y": r"(\d\d\d\d)",
    "m": r"(1[0-2]|0[1-9]|[1-9])",
    "d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])",
    "H": r"(2[0-3]|[0-1]\d|\d)",
    "M": r"([0-5]\d|\d)",
    "S": r"(6[0-1]|[0-5]\d|\d)",
}


def layout_regex(layout: str) -> tuple[str, list[str]]:
    """strptime layout -> (anchored java regex, directive order)."""
    out, order, i = ["(?i)^"], [], 0
    while i < len(layout):
        ch = layout[i]
        if ch == "%":
            d = layout[i + 1]
            out.append(_DIRECTIVE[d])
            order.append(d)
            i += 2
        elif ch.isspace():
            out.append(r"\s+")
            while i < len(layout) and layout[i].isspace():
                i += 1
        else:
            out.append(re.escape(ch))
            i += 1
    out.append("$")
    return "".join(out), order


def _by_regex(s: Column, layout: str) -> Column:
    """ISO text when ``s`` has this layout, else null (one regex replace)."""
    pattern, order = layout_regex(layout)
    group = {d: f"${n + 1}" for n, d in enumerate(order)}
    defaults = {"Y": "1", "m": "1", "d": "1", "H": "0", "M": "0", "S": "0"}
    part = {d: group.get(d, defaults[d]) for d in "YmdHMS"}
    text = F.regexp_replace(s, pattern, "{Y}-{m}-{d} {H}:{M}:{S}".format(**part))
    return F.when(s.rlike(pattern), F.replace(text, F.lit("- "), F.lit("-")))      # a day padded with a blank


def _shape(layout: str) -> str:
    """A zero-padded text of a layout, with every digit a 0."""
    return re.sub("%([YmdHMS])", lambda m: "0000" if m[1] == "Y" else "00", layout)


def _by_place(s: Column, layout: str) -> Column:
    """ISO text cut out of a text that has the layout's shape."""
    at, place = 1, {}
    for piece in re.findall("%[YmdHMS]|.", layout):
        size = 1 if len(piece) == 1 else 4 if piece == "%Y" else 2
        place[piece] = F.substring(s, at, size)
        at += size
    day = F.concat_ws("-", place["%Y"], place["%m"], place["%d"])
    return F.concat_ws(" ", day, F.concat_ws(":", place["%H"], place["%M"], place["%S"])) if "%H" in place else day


def timestamp_parts(s: Column, layouts: Sequence[str]) -> Column:
    """ISO text of the first layout that matches, else null; ``parts_to_timestamp`` checks the values.

    Nearly all texts are zero-padded: they are told by their shape (digits as 0) and cut by place. Only the others meet
    the layouts' regexes. Materialise this in its own projection, so that the work happens once per row.
    """
    shape = F.translate(s, "123456789", "000000000")
    out = None
    for layout in layouts:
        if "%Y" in layout and "%m" in layout and "%d" in layout:
            cut = _by_place(s, layout)
            out = F.when(shape == _shape(layout), cut) if out is None else out.when(shape == _shape(layout), cut)
    others = F.coalesce(*[_by_regex(s, layout) for layout in layouts])
    return others if out is None else out.otherwise(others)


def parts_to_timestamp(parts: Column) -> Column:
    """Timestamp (no zone) from ISO text; null for impossible dates (31/02) and second >= 60."""
    return parts.try_cast("timestamp_ntz")


def parse_timestamp(s: Column, layouts: Sequence[str]) -> Column:
    """One-expression form (fine for a single use; prefer the two-step form in wide projections)."""
    return parts_to_timestamp(timestamp_parts(s, layouts))


def ntz_text(ts: Column, layout: str) -> Column:
    """Text of a zone-less timestamp in one of the export layouts, without the session zone.

    ``date_format`` goes through the session time zone, so a wall-clock time
    that does not exist there (a DST gap at midnight) comes out shifted; the
    cast of TIMESTAMP_NTZ to string does not, and every layout is cut from it.
    """
    s = ts.cast("timestamp_ntz").cast("string")

    def part(start: int, length: int) -> Column:
        return F.substring(s, start, length)

    def time_of_day() -> Column:
        t = part(12, 8)
        return F.when(F.length(t) == 8, t).otherwise(F.lit("00:00:00"))

    if layout == "yyyy-MM-dd HH:mm:ss":
        out = F.concat_ws(" ", part(1, 10), time_of_day())
    elif layout == "dd/MM/yyyy HH:mm:ss":
        out = F.concat_ws(" ", F.concat_ws("/", part(9, 2), part(6, 2), part(1, 4)), time_of_day())
    elif layout == "d/M/yyyy":
        out = F.concat_ws("/", part(9, 2).cast("int").cast("string"), part(6, 2).cast("int").cast("string"),
                          part(1, 4))
    elif layout == "yyyy-MM-dd'T'HH:mm:ss":
        out = F.concat(part(1, 10), F.lit("T"), time_of_day())
    elif layout == "yyyy-MM-dd":
        out = part(1, 10)
    elif layout == "dd/MM/yyyy":
        out = F.concat_ws("/", part(9, 2), part(6, 2), part(1, 4))
    elif layout == "yyyy-MM":
        out = part(1, 7)
    else:
        raise ValueError(f"unsupported layout {layout!r}")
    return F.when(ts.isNotNull(), out)
