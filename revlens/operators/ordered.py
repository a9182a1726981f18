"""G0-G3 — ordered operators over the whole data set, without a single-partition
window.

``F.rank().over(Window.orderBy(...))`` (no PARTITION BY) moves every row into
one task.  For inputs that grow with the data (customers, orders) the
reports use the forms below instead; each is exact and equals the plain
window function (see tests/test_ordered.py).

*Selection* (percentiles, NTILE) finds the rows at given ranks without
ordering the others (``operators.selection``).

* percentile_cont (G3): the two order statistics of each share.
* NTILE (G1): the last row of each tile; a row's tile is one more than the
  number of such rows before it, a comparison per row.  Several NTILEs of one
  table share their passes.

*Sorted ranges* (ranks, running sums): ``repartitionByRange(k)`` +
``sortWithinPartitions`` + a reliable ``checkpoint()`` (written to the
shared ``spark.checkpoint.dir``, so it survives executor loss and pins the
range boundaries; a recomputed range sample could otherwise move rows
between passes).  On the checkpointed rows ``monotonically_increasing_id``
gives (range id, position) for free.  Per-range totals are one row per range
(at most ``k`` rows, a bound fixed by the caller), so their offsets are
computed by a tiny window and broadcast back.

* row number: offset + position.
* RANK (G2) and RANGE running sums (W8c): the rows before a key are those of
  earlier ranges and those before it in its own.  The order ends in a row id,
  so a key that a third of the rows have is spread over many ranges; what a
  range needs to know of the key it begins with is one row a range.  Nothing
  is joined on the ranked value.  With ``partition_by`` the same layout also
  gives the rows before each group.

There is one form, whatever the size of the input.  Selection and the range
sample read the input more than once, so give a materialised one.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.operators.selection import Order, literal, select_ranks, sort_key
from revlens.session import ensure_checkpoint_dir


def _order_exprs(order: Sequence) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _num_ranges(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def sorted_ranges(df: DataFrame, order: Sequence, num_partitions: int | None = None) -> DataFrame:
    """Range-partitioned, sorted, checkpointed copy of ``df`` with columns
    ``_rid`` (range id) and ``_pos`` (0-based position inside the range)."""
    ensure_checkpoint_dir(df.sparkSession)
    exprs = _order_exprs(order)
    k = _num_ranges(df, num_partitions)
    laid_out = df.repartitionByRange(k, *exprs).sortWithinPartitions(*exprs) \
        .checkpoint(eager=True)
    with_id = laid_out.withColumn("_mid", F.monotonically_increasing_id())
    return with_id.select(
        *[F.col(f"`{c}`") for c in laid_out.columns],
        F.shiftright("_mid", 33).alias("_rid"),
        (F.col("_mid") - F.shiftleft(F.shiftright("_mid", 33), 33)).alias("_pos"))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (shared checkpoint folder), so
    that a multi-pass report computes its input once and a lost executor
    re-reads the checkpoint instead of re-running the whole plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _range_offsets(ranges: DataFrame, value: Column | None = None) -> DataFrame:
    """One row per range: rows and (optionally) value sum before it, and totals."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        aggs.append(F.sum(value).alias("_s"))
    per = ranges.groupBy("_rid").agg(*aggs)
    before = Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cols = [F.col("_rid"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
            F.sum("_n").over(whole).alias("_total")]
    if value is not None:
        cols.append(F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_soff"))
    # at most k rows (one per range): a bounded broadcast by construction
    return F.broadcast(per.select(*cols))


def with_row_number(df: DataFrame, order: Sequence, name: str = "row_number",
                    num_partitions: int | None = None, keep_total: str | None = None) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY order)`` without a single partition.

    ``order`` should be a total order (add a unique tie-break)."""
    ranges = sorted_ranges(df, order, num_partitions)
    out = ranges.join(_range_offsets(ranges), "_rid")
    out = out.withColumn(name, F.col("_off") + F.col("_pos") + 1)
    if keep_total:
        out = out.withColumn(keep_total, F.col("_total"))
    return out.drop("_rid", "_pos", "_off", "_total")


def ntile_from_row_number(rn: Column, total: Column, n: int) -> Column:
    """NTILE(n) bucket of 1-based row ``rn`` among ``total`` rows (larger
    buckets first, exactly as the SQL function)."""
    q = F.floor(total / n).cast("long")
    m = (total - q * n).cast("long")
    big = m * (q + 1)
    first = F.floor((rn - 1) / (q + 1)) + 1
    rest = m + F.floor((rn - 1 - big) / F.greatest(q, F.lit(1))) + 1
    return F.when(rn <= big, first).otherwise(rest).cast("int")


def _last_ranks(rows: int, n: int) -> list[int]:
    """Rank (from 0) of the last row of each tile but the last."""
    q, m = divmod(rows, n)
    return [t * q + min(t, m) - 1 for t in range(1, n) if t * q + min(t, m) > 0]


def with_ntiles(df: DataFrame, n: int, orders: Mapping[str, Order],
                rows: int | None = None) -> DataFrame:
    """G1: ``NTILE(n) OVER (ORDER BY order)`` for each name, distributed and
    in shared passes: no row moves.

    An order is a list of columns or (column, descending) pairs and should be
    total (add a unique tie-break): rows equal in all of it share a tile.
    ``rows`` is the number of rows of ``df`` where it is known."""
    rows = df.count() if rows is None else rows
    ranks = _last_ranks(rows, n)
    found = select_ranks(df, [(order, ranks, rows) for order in orders.values()])
    tiles = {}
    for (name, order), (bounds, kind) in zip(orders.items(), found):
        key = sort_key(df, order)
        tiles[name] = sum(((key > literal(b, kind)).cast("int") for b in bounds), F.lit(1))
    return df.withColumns(tiles)


def with_ntile(df: DataFrame, n: int, order: Order, name: str = "ntile") -> DataFrame:
    """G1 for one order."""
    return with_ntiles(df, n, {name: order})


def _key_order(key: str, desc: bool) -> Column:
    return F.col(key).desc_nulls_last() if desc else F.col(key).asc_nulls_first()


def _sums_before(df: DataFrame, order: Sequence[Column], keys: Sequence[Sequence[str]],
                 weight: Column, num_partitions: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` with, for each list of leading sort columns in ``keys``, the sum
    of ``weight`` over all rows that come before the row's value of them.

    The rows are laid out once.  Inside a range the sums are windows over the
    range; a value that began in an earlier range starts where it began there,
    which the table of one row per range tells."""
    laid = sorted_ranges(df.withColumn("_tie", F.monotonically_increasing_id()),
                         [*order, "_tie"], num_partitions).drop("_tie").withColumn("_w", weight)
    exprs = _order_exprs(order)
    local, value = [f"_local{i}" for i in range(len(keys))], [f"_key{i}" for i in range(len(keys))]
    ranged = laid
    for i, names in enumerate(keys):
        through = F.sum("_w").over(Window.partitionBy("_rid").orderBy(*exprs[:len(names)]))
        own = F.sum("_w").over(Window.partitionBy("_rid", *names))
        ranged = ranged.withColumns({local[i]: through - own,
                                     value[i]: F.struct(*[F.col(f"`{c}`") for c in names])})
    ends = ranged.groupBy("_rid").agg(
        F.sum("_w").alias("_sum"), *[f(v, "_pos").alias(f"{v}{end}") for v in value
                                     for f, end in ((F.min_by, "_first"), (F.max_by, "_last"))],
        *[F.max_by(c, "_pos").alias(f"{c}_last") for c in local])
    earlier = Window.orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    for i, v in enumerate(value):
        # a value is a struct, so null only says that there is no range before
        goes_on = F.lag(f"{v}_last").over(Window.orderBy("_rid")).eqNullSafe(F.col(f"{v}_first"))
        only = F.col(f"{v}_first").eqNullSafe(F.col(f"{v}_last"))
        ends = ends.withColumn(f"_goes_on{i}", goes_on)
        ends = ends.withColumn(f"_began{i}", F.when(~(F.col(f"_goes_on{i}") & only),
                                                    F.col("_off") + F.col(f"{local[i]}_last")))
        began = F.last(f"_began{i}", ignorenulls=True).over(earlier)
        ends = ends.withColumn(f"_start{i}", F.when(F.col(f"_goes_on{i}"), began)
                               .otherwise(F.col("_off")))
    # at most k rows (one per range): a bounded broadcast by construction
    known = F.broadcast(ends.select("_rid", "_off", *[F.col(f"{v}_first") for v in value],
                                    *[F.col(f"_start{i}") for i in range(len(keys))]))
    out = ranged.join(known, "_rid")
    sums = [f"_before{i}" for i in range(len(keys))]
    out = out.withColumns({name: F.when(F.col(value[i]).eqNullSafe(F.col(f"{value[i]}_first")),
                                        F.col(f"_start{i}")).otherwise(F.col("_off") + F.col(local[i]))
                           for i, name in enumerate(sums)})
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *sums), sums


def with_rank(df: DataFrame, key: str, desc: bool = True, name: str = "rank",
              num_partitions: int | None = None,
              partition_by: str | None = None) -> DataFrame:
    """``RANK() OVER ([PARTITION BY partition_by] ORDER BY key [DESC])``,
    distributed (gaps after ties; NULL lowest: last in DESC, first in ASC).

    With ``partition_by`` a group may be as large as a third of the input:
    the rank counts the rows before (group, key) in composite order minus the
    rows before the group, so no group is ordered inside one task."""
    group = [] if partition_by is None else [partition_by]
    order = [*[F.col(g).asc_nulls_first() for g in group], _key_order(key, desc)]
    keys = [[*group, key], group] if group else [[key]]
    out, (before, *start) = _sums_before(df, order, keys, F.lit(1).cast("long"), num_partitions)
    rank = F.col(before) + 1 - (F.col(start[0]) if start else F.lit(0))
    return out.withColumn(name, rank.cast("int")).drop(before, *start)


def with_range_cumsum(df: DataFrame, key: str, value: str, desc: bool = True,
                      name: str = "cumulative", num_partitions: int | None = None) -> DataFrame:
    """``SUM(value) OVER (ORDER BY key [DESC])`` with the default RANGE
    frame — rows with equal keys share one cumulative value: the total less
    what comes before the key in the opposite order."""
    backwards = F.col(key).asc_nulls_first() if desc else F.col(key).desc_nulls_last()
    out, (before,) = _sums_before(df, [backwards], [[key]], F.coalesce(F.col(value), F.lit(0)),
                                  num_partitions)
    return out.withColumn(name, df.agg(F.sum(value)).scalar() - F.col(before)).drop(before)


def percentile_values(df: DataFrame, shares: Mapping[str, Sequence[float]]
                      ) -> dict[str, list[float | None]]:
    """Exact ``PERCENTILE_CONT`` of several columns (NULLs ignored) for
    several shares each, with linear interpolation between the two order
    statistics; None for a column without values.  All columns share the
    passes over ``df``."""
    if any(not 0.0 <= p <= 1.0 for ps in shares.values() for p in ps):
        raise ValueError("p must be in [0, 1]")
    counts = df.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(shares)],
                    F.count(F.lit(1)).alias("rows")).first()
    wanted, places = [], []
    for i, (column, ps) in enumerate(shares.items()):
        rows, nulls = counts[f"n{i}"], counts["rows"] - counts[f"n{i}"]
        at = [p * (rows - 1) for p in ps] if rows else []
        ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
        places.append((at, ranks))
        wanted.append(([column], [r + nulls for r in ranks], counts["rows"]))   # NULLs come first
    out = {}
    for (column, ps), (at, ranks), (found, _) in zip(shares.items(), places, select_ranks(df, wanted)):
        value = {r: float(key[1]) for r, key in zip(ranks, found)}
        out[column] = [value[math.floor(x)] + (value[math.ceil(x)] - value[math.floor(x)])
                       * (x - math.floor(x)) for x in at] or [None] * len(ps)
    return out


def percentiles_cont(df: DataFrame, col: str, shares: Sequence[float],
                     names: Sequence[str] | None = None) -> DataFrame:
    """G3 of one column as a one-row DataFrame."""
    names = list(names or [f"p{i}" for i in range(len(shares))])
    values = percentile_values(df, {col: shares})[col]
    return df.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(n)
                                             for v, n in zip(values, names)])


def percentile_cont(df: DataFrame, col: str, p: float = 0.5, name: str = "percentile") -> DataFrame:
    """G3 for one share."""
    return percentiles_cont(df, col, [p], [name])
