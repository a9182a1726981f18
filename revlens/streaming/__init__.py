"""Structured Streaming form of the bulk load (see incremental.py).

The reference has no streaming analytics (no event time, windows or state);
the only continuous step is loading exported files into the sales table."""
