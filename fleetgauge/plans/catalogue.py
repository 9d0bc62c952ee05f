"""Loads every report module so that the registry is complete."""

from . import catalog_reports, history_reports, layout_reports, performance_reports, queue_reports, relational_reports  # noqa: F401
from . import source_reports, transaction_reports, window_reports  # noqa: F401
from .registry import CHECKS, QUERIES  # noqa: F401
