"""Text helpers for statements, identifiers and host names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .temporal import as_col

# Words that mark internal statements, then statement classes in test order, first match
# wins; letter case does not matter for the classes.
INTERNAL_MARKS = ("padb_", "pg_internal")
STATEMENT_CLASSES = [
    ("ROLLBACK", "undoing "), ("CURSOR", "cursor "), ("CURSOR", "fetch "), ("DELETE", "delete "), ("COPY", "copy "),
    ("UPDATE", "update "), ("INSERT", "insert "), ("SELECT", "select "),
]
SYSTEM_USER = 1


def trimmed(c) -> Column:
    return F.trim(as_col(c))


def quote_ident(c) -> Column:
    """Double-quote a name unless it is a plain lower-case identifier."""
    c = as_col(c)
    plain = c.rlike("^[a-z_][a-z0-9_$]*$")
    return F.when(plain, c).otherwise(
        F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    )


def qualified(schema, name) -> Column:
    return F.concat(quote_ident(schema), F.lit("."), quote_ident(name))


def host_name(url) -> Column:
    """Host part of a URL in lower case; NULL where the text is not a URL."""
    return F.lower(F.try_parse_url(as_col(url), F.lit("HOST")))


def leading_word(c) -> Column:
    """First word of a statement, upper case; NULL when it starts with something else."""
    return F.upper(F.nullif(F.regexp_extract(as_col(c), r"^\s*([A-Za-z]+)", 1), F.lit("")))


def statement_class(text, userid, lowered=None) -> Column:
    """Kind of a statement. ``lowered`` may pass the lower-case text computed once before."""
    text, userid = as_col(text), as_col(userid)
    low = F.lower(text) if lowered is None else as_col(lowered)
    out = F.when(userid == SYSTEM_USER, "SYSTEM")
    for mark in INTERNAL_MARKS:
        out = out.when(F.contains(text, F.lit(mark)), "SYSTEM")
    for name, word in STATEMENT_CLASSES:
        out = out.when(F.contains(low, F.lit(word)), name)
    return out.otherwise("OTHER")


def one_line(c) -> Column:
    """Drop tabs and line breaks, as the live queue report prints its statements."""
    return F.trim(F.translate(as_col(c), "\n\r\t", ""))
