"""Name and text helpers as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pattern of a legal factor name.
NAME = "^[A-Za-z0-9][A-Za-z0-9_.-]*$"
SPACE = r"(?U)\s+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x, chars: str = r"\s") -> Column:
    return F.regexp_replace(_c(x), f"(?U)^[{chars}]+|[{chars}]+$", "")


def name_kebab(x) -> Column:
    """CamelCase and illegal runs to a lower-case dashed name."""
    dashed = F.regexp_replace(F.regexp_replace(_c(x), "(?<!^)(?=[A-Z])", "-"), "_", "-")
    return F.lower(strip(F.regexp_replace(dashed, "[^A-Za-z0-9_.-]+", "-"), "-"))


def name_valid(x) -> Column:
    return F.coalesce(_c(x).rlike(NAME), F.lit(False))


def safe_token(x, fallback: str = "pattern", limit: int = 64) -> Column:
    """Letters and digits of a text, runs of others as `_`; the token has `limit` characters, so no more letters and digits reach it."""
    reach = F.regexp_extract(F.lower(_c(x)), rf"^(?:[^0-9A-Za-z]*+[0-9A-Za-z]){{0,{limit}}}", 0)
    raw = strip(F.regexp_replace(reach, "[^0-9A-Za-z]+", "_"), "_")
    cut = F.regexp_replace(F.substring(raw, 1, limit), "_+$", "")
    return F.when(F.length(cut) > 0, cut).otherwise(fallback)


# Notes behind a shortened text, and what a text is shortened by to make room for them.
NOTE, LINE_NOTE = " ... [truncated]", "\n... [truncated]"
LIST_MARGIN, INLINE_MARGIN, LINES_MARGIN = 36, 15, 18


def compact(x, limit: int = 1200, margin: int = LIST_MARGIN) -> Column:
    """Whitespace runs to one space; beyond the limit cut by the margin, with a note."""
    flat = strip(F.regexp_replace(F.coalesce(_c(x), F.lit("")), SPACE, " "))
    head = F.regexp_replace(F.substring(flat, 1, limit - margin), r"(?U)\s+$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(head, F.lit(NOTE)))


def compact_lines(x, limit: int) -> Column:
    """Cut beyond the limit, line breaks kept."""
    text = F.coalesce(_c(x), F.lit(""))
    head = F.regexp_replace(F.substring(text, 1, max(0, limit - LINES_MARGIN)), r"(?U)\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(LINE_NOTE)))


def unique_list(arr: Column) -> Column:
    """First spelling of each value, case-insensitively, in order, empties dropped."""
    full = F.filter(arr, lambda v: F.length(v) > 0)
    low = F.transform(full, lambda v: F.lower(v))
    return F.filter(full, lambda v, i: F.array_position(low, F.lower(v)) == i + 1)


def list_items(x) -> Column:
    """Comma, semicolon or line separated values, cleaned and unique."""
    parts = F.split(_c(x), r"[,;\n]+")
    return unique_list(F.transform(parts, lambda v: strip(v, " \\-`'\\t\"")))


def _named(heading: str) -> str:
    """Pattern of a heading's name between blanks and hashes."""
    return "[# \\t]*" + "".join("\\" + c if not c.isalnum() and c != " " else c for c in heading) + "[# \\t]*$"


def _section(heading: str, run: bool) -> str:
    other = f"(?!{_named(heading)})" if run else ""
    return rf"(?ims)^[ \t]*##[ ]{_named(heading)}\n?(.*?)(?=^[ \t]*##[ ]{other}|\z)"


def section(x, heading: str, run: bool = False) -> Column:
    """Text between a `## heading` line and the next `## ` line, NULL if absent.

    With `run` directly following sections of that name belong to it; their heading lines stay in the text.
    """
    pattern = _section(heading, run)
    return F.when(_c(x).rlike(pattern), F.regexp_extract(_c(x), pattern, 1))


def section_body(x, heading: str) -> Column:
    """`section` with `run`, in one search of the text; empty if absent."""
    return F.regexp_extract(_c(x), _section(heading, True), 1)


def sections(x, heading: str) -> Column:
    """Texts of all sections of a name, in order."""
    pattern = rf"(?ims)^[ \t]*##[ ]{_named(heading)}\n?(.*?)(?=^[ \t]*##[ ]|\z)"
    return F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(1))
