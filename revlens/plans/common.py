"""Shared helpers of the report modules."""

from __future__ import annotations


def reads(*columns: str):
    """Declare the fact columns a report reads (lets the fact builder leave
    out lookups the report does not need)."""
    def mark(fn):
        fn.reads = tuple(columns)
        return fn
    return mark
