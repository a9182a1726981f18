"""revlens — sales-performance analytics on Spark DataFrames.

Layout:
  sources/    reading sheets and driver tables, building the sales fact, sinks
  functions/  column-level semantics (rounding, labels, calendar arithmetic)
  operators/  reusable DataFrame operators (cleaning, lookup joins, features,
              data quality, distributed ordered operators)
  plans/      the report catalogue (B1-B18), derived tables (D1-D7), the grain
              aggregates and the suite that runs the catalogue from them, the
              cleaning flow, DuckDB oracles and the query registry
  streaming/  incremental (Structured Streaming) form of the bulk load

Command line: ``python -m revlens {list,build-fact,profile,clean,report}``.
"""

__version__ = "0.1.0"
