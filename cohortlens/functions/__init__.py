"""Column-level building blocks: time parsing, predicates, vector arithmetic."""

from .predicates import header_row, is_after_hours
from .timeparse import TIMESTAMP_FORMATS, event_hour, parse_event_time
from .vectors import (
    dot,
    matrix_literal,
    nearest_index,
    sq_dist,
    sq_norm,
)

__all__ = [
    "TIMESTAMP_FORMATS",
    "dot",
    "event_hour",
    "header_row",
    "is_after_hours",
    "matrix_literal",
    "nearest_index",
    "parse_event_time",
    "sq_dist",
    "sq_norm",
]
