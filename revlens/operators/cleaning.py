"""P1-P7 — column repair and reshaping of raw sheets.

P1 promote a header row, P2/P3 fold column names, P4 drop (ignoring missing),
P5 strict subset + reorder, P6 simultaneous rename, P7 masked update.
All are projections: no shuffle, and Catalyst prunes what is not used.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def _checked_names(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    for n in names:
        seen[n] = seen.get(n, 0) + 1
    dup = sorted(n for n, k in seen.items() if k > 1)
    if dup:
        raise ValueError(f"column names collide after folding: {dup}")
    return list(names)


def normalize_columns(df: DataFrame, strip: bool = True) -> DataFrame:
    """P2 (lower + strip) / P3 (lower only) on column *names*."""
    names = [c.strip().lower() if strip else c.lower() for c in df.columns]
    return df.toDF(*_checked_names(names))


def promote_header(df: DataFrame, header_values: Sequence[str] | None = None,
                   order_col: str | None = None) -> DataFrame:
    """A sheet whose real header sits in its first data row.

    The header row is the one with the smallest ``order_col`` (the place that
    ``sources.sheets.positioned_sheet`` adds), or, without one, the one row
    that equals ``header_values`` when both are trimmed and lower-cased.  With
    both, the first row must equal the values.  Exactly one row goes: by
    position, a later row that equals the header stays; a sheet without such a
    row, or with several and no position, is an error.  The first row is found
    by one aggregation (a row a task is shuffled, nothing is sorted) and left
    out by a filter on its place; at most two rows come to the driver."""
    cols = [c for c in df.columns if c != order_col]
    if header_values is None and order_col is None:
        raise ValueError("promote_header needs header_values or order_col")
    if header_values is not None and len(header_values) != len(cols):
        raise ValueError("header_values must name every column")

    def folded(value) -> str:
        return str(value).strip().lower()

    if order_col is not None:
        row = F.min(F.struct(F.col(order_col).alias("at"), F.struct(*cols).alias("row")))
        first = df.agg(row.alias("first")).first()["first"]
        if first is None:
            raise ValueError("the sheet has no header row")
        names = [str(first["row"][c]) for c in cols]
        if header_values is not None and list(map(folded, names)) != list(map(folded, header_values)):
            raise ValueError(f"the first row is not the header: {names}")
        at = first["at"]
        place = F.struct(*[F.lit(v) for v in at]) if isinstance(at, Row) else F.lit(at)
        body = df.filter(F.col(order_col) != place.cast(df.schema[order_col].dataType))
    else:
        is_header = F.lit(True)
        for c, v in zip(cols, header_values):
            is_header = is_header & (F.lower(F.trim(F.col(c).cast("string"))) == F.lit(folded(v)))
        is_header = F.coalesce(is_header, F.lit(False))
        found = df.filter(is_header).limit(2).count()
        if found != 1:
            raise ValueError("the sheet has no header row" if not found else
                             "several rows equal the header; give order_col")
        body = df.filter(~is_header)
        names = [str(v) for v in header_values]
    return body.select(*[F.col(c).alias(n) for c, n in zip(cols, names)])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop, ignoring names that are not present."""
    return df.drop(*cols)


def select_strict(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P5: subset + reorder; a missing column is an error."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*[F.col(f"`{c}`") for c in cols])


def rename_simultaneous(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename all pairs at once (``a->b`` and ``b->c`` do not chain).

    One projection; ``withColumnsRenamed`` applied pair by pair would turn
    ``state_code->state, state->state_name`` into two ``state_name`` columns."""
    unknown = [k for k in mapping if k not in df.columns]
    if unknown:
        raise ValueError(f"cannot rename missing columns: {unknown}")
    names = _checked_names([mapping.get(c, c) for c in df.columns])
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])


def mask_outside_year(df: DataFrame, value_col: str, date_col: str, year: int) -> DataFrame:
    """Keep ``value_col`` only on rows dated in ``year``; NULL elsewhere
    (a NULL date also gives NULL)."""
    keep = F.year(F.col(date_col)) == F.lit(year)
    return df.withColumn(value_col, F.when(keep, F.col(value_col)))


def apply_collation(df: DataFrame, columns: Sequence[str],
                    collation: str = "UTF8_LCASE_RTRIM") -> DataFrame:
    """Compare/group text like SQL Server's default collation: case
    insensitive and blind to trailing blanks ('Ab' groups with 'aB ').
    The default (binary) comparison is what the reports use."""
    return df.withColumns({c: F.collate(F.col(c), collation) for c in columns})


def preview(df: DataFrame, n: int = 100) -> DataFrame:
    """``TOP n *`` / ``head(n)`` made deterministic — the first ``n``
    rows in the order of all columns (a top-k, not a full sort)."""
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in df.columns]).limit(n)
