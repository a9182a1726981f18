"""Reusable DataFrame operators: cleaning (P1-P7), lookup joins (J1-J6, Q6),
features (F1-F6), data quality (Q1-Q5) and distributed ordered operators
(G0-G3: row number, NTILE, RANK, RANGE running sum, percentile)."""
