"""J1-J6 — lookup (dimension) joins with a fan-out guard, Q6 unmatched keys.

The reference enriches its order lines with five left joins and prints the
row count after each to make sure it did not change.  Here the guard is a
uniqueness check on the *dimension* keys (the big side is never counted),
executed as one distributed aggregation, or a skew-safe de-duplication, or a
``JoinWatch``: observed metrics of every join (rows in, rows out, rows without
a match, missing keys), gathered by the job that computes the result anyway.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A lookup table has more than one row for some key (would fan out)."""


@dataclass(frozen=True)
class JoinCounts:
    """What a left join did: a row without a match has a key that the lookup
    lacks, or (``null_keys`` of them) a missing key."""
    name: str
    rows_in: int
    rows_out: int
    unmatched: int
    null_keys: int


class JoinWatch:
    """Metrics of lookup joins, counted inside the job that runs them.

    Give it to the joins, run an action on their result, then read
    ``counts()``: no job of its own.  Counts are of the first action; a stage
    that Spark runs again after losing an executor may count rows twice, so
    ``check`` is a gate against bad data and no ledger."""

    def __init__(self) -> None:
        self._joins: list[tuple[str, Observation, Observation]] = []

    def join(self, fact: DataFrame, name: str, left_keys: Sequence[str], run) -> DataFrame:
        """``run(fact, hit)`` joins and leaves the column ``hit``, null in
        rows without a match."""
        number, hit = len(self._joins), f"_hit{len(self._joins)}"
        before, after = (Observation(f"{name} {number} {end}") for end in ("in", "out"))
        missing = F.lit(False)
        for key in left_keys:
            missing = missing | F.col(f"`{key}`").isNull()
        joined = run(fact.observe(before, F.count(F.lit(1)).alias("rows"),
                                  F.count_if(missing).alias("null_keys")), hit)
        self._joins.append((name, before, after))
        return joined.observe(after, F.count(F.lit(1)).alias("rows"),
                              F.count_if(F.col(hit).isNull()).alias("unmatched")).drop(hit)

    def counts(self) -> list[JoinCounts]:
        return [JoinCounts(name, before.get["rows"], after.get["rows"], after.get["unmatched"],
                           before.get["null_keys"]) for name, before, after in self._joins]

    def check(self) -> None:
        """Raises if a lookup has several rows for some key."""
        grown = [f"{c.name} ({c.rows_in} rows became {c.rows_out})" for c in self.counts()
                 if c.rows_out > c.rows_in]
        if grown:
            raise DuplicateKeyError(f"duplicate keys in {', '.join(grown)}")

    def lost(self) -> str:
        """The lookups that left rows without a match, as text."""
        return ", ".join(f"{c.name}: {c.unmatched} of {c.rows_in} rows without a match"
                         + (f" ({c.null_keys} without a key)" if c.null_keys else "")
                         for c in self.counts() if c.unmatched)


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def duplicate_keys(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in ``dim`` with their multiplicity."""
    keys = _as_list(keys)
    return (dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") > 1))


def check_unique(dim: DataFrame, keys: Sequence[str], name: str = "lookup") -> None:
    """Raise ``DuplicateKeyError`` if some key of ``dim`` repeats."""
    dups = duplicate_keys(dim, keys).limit(5).collect()
    if dups:
        raise DuplicateKeyError(f"{name}: duplicate keys {[tuple(r) for r in dups]}")


def dedupe_first(dim: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """One row per key: the row with the smallest ``order_by``, NULLs last,
    ties by the other columns.

    ``min`` of a struct is an aggregate with partial (map-side) combine, so a
    key that repeats a billion times costs one row per partition in the
    shuffle; the struct itself is never NULL, so no value is lost."""
    keys = _as_list(keys)
    rest = [c for c in dim.columns if c not in keys]
    order = [F.col(order_by).isNull().alias("_unknown"), F.col(order_by).alias("_order")]
    packed = F.min(F.struct(*order, *[F.col(c) for c in rest])).alias("_row")
    return dim.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup_join(fact: DataFrame, dim: DataFrame, left_on, right_on=None, *,
                how: str = "left", on_duplicate: str = "error", order_by: str | None = None,
                null_safe: bool = False, drop_right_keys: bool = False,
                name: str = "lookup", watch: JoinWatch | None = None) -> DataFrame:
    """Left (by default) equi-join of a fact with a lookup table.

    * ``right_on=None`` joins on same-named keys and keeps one key column (J5).
    * ``on_duplicate``: ``'error'`` (J6 check first), ``'first'`` (keep the
      row with the smallest ``order_by``), ``'trust'`` (declared primary key)
      or ``'watch'`` (``watch.check()`` after the action).
    * ``watch`` counts rows in and out, unmatched rows and missing keys.
    * ``null_safe``: NULL keys match NULL keys (pandas ``merge`` parity);
      the default is SQL equality.
    * non-key column names that exist on both sides are an error.
    """
    left_keys = _as_list(left_on)
    right_keys = left_keys if right_on is None else _as_list(right_on)
    if len(left_keys) != len(right_keys):
        raise ValueError("left_on and right_on differ in length")
    if on_duplicate == "error":
        check_unique(dim, right_keys, name)
    elif on_duplicate == "first":
        if order_by is None:
            raise ValueError("on_duplicate='first' needs order_by")
        dim = dedupe_first(dim, right_keys, order_by)
    elif on_duplicate == "watch":
        if watch is None:
            raise ValueError("on_duplicate='watch' needs watch")
    elif on_duplicate != "trust":
        raise ValueError(f"unknown on_duplicate={on_duplicate!r}")

    shared_keys = set(left_keys) if right_on is None else set()
    clash = (set(fact.columns) & set(dim.columns)) - shared_keys
    if clash:
        raise ValueError(f"{name}: ambiguous columns on both sides: {sorted(clash)}")

    if watch is None:
        return _join(fact, dim, left_keys, right_keys, right_on is None, how, null_safe, drop_right_keys)
    return watch.join(fact, name, left_keys, lambda source, hit: _join(
        source, dim.withColumn(hit, F.lit(True)), left_keys, right_keys, right_on is None, how,
        null_safe, drop_right_keys))


def _join(fact, dim, left_keys, right_keys, same_names, how, null_safe, drop_right_keys) -> DataFrame:
    if same_names and not null_safe:
        return fact.join(dim, on=left_keys, how=how)
    cond: Column | None = None
    for lk, rk in zip(left_keys, right_keys):
        part = fact[lk].eqNullSafe(dim[rk]) if null_safe else fact[lk] == dim[rk]
        cond = part if cond is None else cond & part
    out = fact.join(dim, on=cond, how=how)
    if same_names:  # null-safe same-name join: keep the fact's key column
        return out.select(*[fact[c] for c in fact.columns],
                          *[dim[c] for c in dim.columns if c not in left_keys])
    return out.drop(*[dim[k] for k in right_keys]) if drop_right_keys else out


def unmatched_counts(fact: DataFrame, dim: DataFrame, left_on, right_on=None,
                     name: str = "lookup") -> DataFrame:
    """Q6: fact rows whose key finds no lookup row (one aggregation pass).

    Returns one row: ``lookup, fact_rows, unmatched_rows``.  The dimension
    keys are de-duplicated first, so the count is exact even with fan-out."""
    left_keys = _as_list(left_on)
    right_keys = left_keys if right_on is None else _as_list(right_on)
    keys = dim.select(*[F.col(r).alias(f"_k{i}") for i, r in enumerate(right_keys)]).distinct() \
        .withColumn("_hit", F.lit(True))
    cond = None
    for i, lk in enumerate(left_keys):
        part = fact[lk] == keys[f"_k{i}"]
        cond = part if cond is None else cond & part
    joined = fact.select(*left_keys).join(keys, cond, "left")
    return joined.agg(
        F.lit(name).alias("lookup"),
        F.count(F.lit(1)).alias("fact_rows"),
        F.count_if(F.col("_hit").isNull()).alias("unmatched_rows"))
