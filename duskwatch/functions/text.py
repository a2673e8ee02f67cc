"""Text of reports, programs, prompts and errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut lengths for console lines, report bodies and table cells, and what is put
# in place of the rest.
ECHO_LIMIT = 400
REPORT_LIMIT = 1_000
CELL_LIMIT = 300
ECHO_NOTE = "... ({} more chars, rerun with --debug to see all)"
REPORT_NOTE = "\n... (truncated)"
CELL_NOTE = "…"


def echo_excerpt(text: Column, limit: int = ECHO_LIMIT) -> Column:
    """Trimmed text for a console line, with the number of characters left out."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    more = (F.length(body) - limit).cast("string")
    note = F.replace(F.lit(ECHO_NOTE), F.lit("{}"), more)
    cut = F.concat(F.substring(body, 1, limit), note)
    return F.when(F.length(body) > limit, cut).otherwise(body)


def report_excerpt(text: Column, limit: int = REPORT_LIMIT) -> Column:
    """Text for a report, cut with a closing note."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(REPORT_NOTE))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def cell_excerpt(text: Column, limit: int = CELL_LIMIT) -> Column:
    """Text for a table cell, cut with an ellipsis."""
    cut = F.concat(F.substring(text, 1, limit), F.lit(CELL_NOTE))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def strip_comments(text: Column) -> Column:
    """Each line up to its first ``#``."""
    return F.regexp_replace(text, r"#[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", "")


def block_quote(text: Column) -> Column:
    """Trimmed text with every line quoted; null when nothing is left."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(body != "", F.concat(F.lit("> "), F.replace(body, F.lit("\n"), F.lit("\n> "))))


def reply_kind(reply: Column) -> Column:
    """What a user's checkpoint reply asks for: stop, continue, or a new focus."""
    body = F.regexp_replace(reply, r"^\s+|\s+$", "")
    topic = F.regexp_replace(F.replace(body, F.lit("focus on "), F.lit("")), r"^\s+|\s+$", "")
    kind = (
        F.when(F.lower(body) == "stop", "stop")
        .when(F.lower(body) == "continue", "continue")
        .otherwise("focus")
    )
    return F.struct(
        kind.alias("kind"),
        F.when((kind == "focus") & (topic != ""), topic).alias("focus"),
    )


def error_key(message: Column) -> Column:
    """Error text with addresses, paths, ids and numbers blanked, so that like errors group."""
    out = F.regexp_replace(message, r"[a-z]+://[^\s'\"]+", "<url>")
    out = F.regexp_replace(out, r"(/[A-Za-z0-9._-]+)+", "<path>")
    out = F.regexp_replace(out, r"\b[0-9a-f]{8,}(-[0-9a-f]{4,})*\b", "<id>")
    out = F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)*\b", "<n>")
    return out


# What a saved program may not contain.
MAIN_GUARD = r"""(?md)^if __name__ == ['"]__main__['"]\s*:[ \t]*(?:#.*)?\n"""
ARGV_USE = r"\bsys\.argv\b"


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def _common_prefix(low: Column, high: Column) -> Column:
    same = F.filter(
        F.sequence(F.lit(0), F.length(low)),
        lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n),
    )
    return F.substring(low, F.lit(1), F.array_max(same))


def dedent(text: Column) -> Column:
    """Remove the indent that all non-blank lines share; blank lines become empty."""
    clean = F.regexp_replace(text, r"(?md)^[ \t]+$", "")
    indents = F.regexp_extract_all(clean, F.lit(r"(?md)^[ \t]*(?=[^ \t\n])"), F.lit(0))
    # The common prefix of a set of strings is that of its smallest and largest member.
    ends = _bind(indents, lambda i: F.struct(F.array_min(i).alias("low"), F.array_max(i).alias("high")))
    margin = _bind(ends, lambda e: _common_prefix(e["low"], e["high"]))
    return F.regexp_replace(clean, F.concat(F.lit("(?md)^"), F.coalesce(margin, F.lit(""))), F.lit(""))


def drop_main_guard(text: Column) -> Column:
    """Text without its first main guard, the guarded body dedented; unchanged without one."""
    # The place of the match, not of its text, which may be quoted before.
    at = F.regexp_instr(text, F.lit(MAIN_GUARD))
    guard = F.regexp_substr(text, F.lit(MAIN_GUARD))
    before = F.substring(text, F.lit(1), at - 1)
    after = F.substring(text, at + F.length(guard), F.length(text))
    return F.when(at > 0, F.concat(before, dedent(after))).otherwise(text)
