"""Optimizer alert events: names, bit values and short labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .temporal import as_col

# Event name, bit, short label in the top-statement list, label in the alert text.
ALERTS = [
    ("Very selective query filter", 1, "Filter", "SK"),
    ("Scanned a large number of deleted rows", 2, "Deleted", "Del"),
    ("Nested Loop Join in the query plan", 4, "Nested Loop", "NL"),
    ("Distributed a large number of rows across the network", 8, "Distributed", "Dist"),
    ("Broadcasted a large number of rows across the network", 16, "Broadcast", "Bcast"),
    ("Missing query planner statistics", 32, "Stats", "Stats"),
]


def alert_kind(event) -> Column:
    """The part of an event text before its detail."""
    return F.trim(F.split_part(as_col(event), F.lit(":"), F.lit(1)))


def alert_bit(event) -> Column:
    kind = alert_kind(event)
    out = F.when(F.lit(False), 0)
    for name, bit, _, _ in ALERTS:
        out = out.when(kind == name, bit)
    return out.otherwise(0).cast("long")


def alert_label(kind) -> Column:
    """Short label of a known event kind; an unknown kind stays as it is."""
    kind = as_col(kind)
    out = F.when(F.lit(False), kind)
    for name, _, label, _ in ALERTS:
        out = out.when(kind == name, label)
    return out.otherwise(kind)


def alert_text(mask) -> Column:
    """Labels of the bits set in ``mask``, separated by blanks; empty text for no bits."""
    mask = as_col(mask)
    return F.when(mask.isNotNull(), F.concat_ws(
        " ", *[F.when(mask.bitwiseAND(bit) == bit, F.lit(text)) for _, bit, _, text in ALERTS]
    ))
