"""Sources and sinks: driver tables -> sales fact (tables), sheet catalogues
and typed CSV load (sheets), CSV / Parquet / table writers (sinks)."""
