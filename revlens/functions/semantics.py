"""Column-level semantics of the reports.

Every helper returns a ``Column`` built from Spark built-ins, so it stays
inside whole-stage codegen.  The traps they encode:

* sums are scaled and rounded in DECIMAL (exact, order independent);
* means and ratios are doubles snapped to n decimals through DECIMAL
  (``snap_round``) so that half-way ties round the same on every engine;
* percent labels print like ``54.2%`` / ``5 %`` (no trailing ``.0``) and a
  NULL number still yields the suffix, as T-SQL ``CONCAT`` does;
* month differences count calendar boundaries crossed, as T-SQL
  ``DATEDIFF(MONTH, a, b)`` does.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit scales used by the reports.
MILLION = Decimal("0.000001")
THOUSAND = Decimal("0.001")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dec_lit(value) -> Column:
    """A DECIMAL literal (keeps decimal arithmetic exact)."""
    return F.lit(Decimal(str(value)))


def scale_round_dec(c, scale=None, digits: int = 2) -> Column:
    """F7/F8 on exact decimals: ``ROUND(c * scale, digits)`` half-up, DECIMAL result."""
    c = _col(c)
    if scale is not None:
        c = c * F.lit(Decimal(str(scale)))
    return F.round(c, digits)


def scale_round(c, scale=None, digits: int = 2) -> Column:
    """``scale_round_dec`` cast to DOUBLE (the final projection form)."""
    return scale_round_dec(c, scale, digits).cast("double")


def snap_round(c, digits: int) -> Column:
    """Round a DOUBLE half-up at ``digits`` through DECIMAL(28,10).

    Plain ``round(double)`` differs between engines at decimal ties (1.005);
    snapping to 10 decimals first makes the tie explicit and exact."""
    return F.round(_col(c).cast("decimal(28,10)"), digits).cast("double")


def exact_mean(c) -> Column:
    """Mean of a DECIMAL column as DOUBLE: ``CAST(SUM(c) AS DOUBLE) / COUNT(c)``.

    ``F.avg`` on decimals truncates at scale+4 and on doubles depends on the
    summation order; this form is exact up to one final division."""
    c = _col(c)
    return F.sum(c).cast("double") / F.count(c)


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)`` — NULL instead of an error or infinity."""
    return F.try_divide(_col(num), F.nullif(_col(den), F.lit(0)))


def pct_change(cur, prev) -> Column:
    """F16: ``(cur - prev) / prev * 100`` with a NULL for a zero/NULL base."""
    cur, prev = _col(cur), _col(prev)
    return safe_div(cur - prev, prev) * 100


def share_pct(part, total) -> Column:
    """``part / total * 100`` with a zero guard."""
    return safe_div(part, total) * 100


def num_text(c) -> Column:
    """number to plain text, without trailing zeros (``5.0`` -> ``5``,
    ``1.5e7`` -> ``15000000``).

    The number goes through DECIMAL(28,10), so large values have no exponent;
    all their digits are shown, where T-SQL's conversion of FLOAT keeps six."""
    plain = _col(c).cast("decimal(28,10)").cast("string")
    return F.regexp_replace(plain, r"\.?0+$", "")


def pct_label(c, suffix: str) -> Column:
    """``CONCAT(number, suffix)`` with T-SQL's NULL-as-empty rule."""
    return F.concat_ws("", num_text(c), F.lit(suffix))


# English month names, January first.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August",
               "September", "October", "November", "December")


def month_name_of(month_no) -> Column:
    """Full English month name of a month number 1-12 (locale independent).

    The NULL guard is explicit: ``element_at`` with a NULL index was seen to
    return a value here instead of NULL."""
    m = _col(month_no)
    return F.when(m.isNotNull(), F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), m))


def month_name(d) -> Column:
    """full English month name of a date.  Spark's ``monthname`` gives
    'Feb' and ``date_format(d, 'MMMM')`` follows the JVM locale; a fixed
    name list indexed by the month number is neither."""
    return month_name_of(F.month(_col(d)))


def month_boundaries(start, end) -> Column:
    """number of month boundaries crossed from ``start`` to ``end``
    (2014-01-31 -> 2014-02-01 is 1)."""
    s, e = _col(start), _col(end)
    return (F.year(e) * 12 + F.month(e)) - (F.year(s) * 12 + F.month(s))


def day_diff(start, end) -> Column:
    """``DATEDIFF(DAY, start, end)`` (note Spark's argument order)."""
    return F.datediff(_col(end), _col(start))


def first_match(rules: Sequence[tuple[Column, object]], otherwise) -> Column:
    """Searched CASE, first matching rule wins."""
    expr = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return other if expr is None else expr.otherwise(other)


def range_bucket(c, edges: Iterable[tuple[object, object, str]],
                 below: tuple[object, str] | None, above_label: str) -> Column:
    """Closed-open range bucketing.

    ``edges`` are ``(lo, hi, label)`` tested in order as ``lo <= c < hi``;
    ``below`` is ``(bound, label)`` for ``c < bound``; everything else
    (including NULL) gets ``above_label``."""
    c = _col(c)
    rules = [((c >= dec_lit(lo)) & (c < dec_lit(hi)), label) for lo, hi, label in edges]
    if below is not None:
        rules.append((c < dec_lit(below[0]), below[1]))
    return first_match(rules, above_label)


def half_even(c, digits: int = 2) -> Column:
    """banker's rounding (pandas ``round``) on an exact decimal."""
    return F.bround(_col(c), digits)
