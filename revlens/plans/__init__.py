"""Report catalogue (B1-B18), derived tables (D1-D7), the cleaning pipeline,
operator-level queries, DuckDB oracles and the query registry."""
