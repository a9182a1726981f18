"""Selection — the rows at given ranks, without ordering the others.

1. A bounded random sample is ordered in one task; the keys around a rank's
   place in it bracket the rank.
2. One aggregation counts the rows outside the brackets and the distinct keys
   inside; only these keys, a bounded number, are ordered, and the counts tell
   which of them stands at the rank.

While the brackets hold too many rows, the rows inside are counted and
sampled again.  A bracket that misses its rank is noticed by the counts and
drawn anew, so the answer is exact, whatever the sample was.  A key that a
third of the rows have is one row in every step.

What comes to the driver is a row of keys a step.  Every step reads the rows,
so give materialised ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 1 << 15      # sampled keys, ordered in one task
BRACKET_ROWS = 1 << 16     # keys inside brackets, ordered in one task

Order = Sequence["str | tuple[str, bool]"]       # column, or (column, descending)


def sort_key(df: DataFrame, order: Order) -> Column:
    """One struct that sorts ascending as ``order`` does (NULL lowest: first
    ascending, last descending).  A descending column must be a number."""
    parts = []
    for i, item in enumerate(order):
        name, desc = (item, False) if isinstance(item, str) else item
        value = F.col(f"`{name}`")
        if desc and not isinstance(df.schema[name].dataType, T.NumericType):
            raise ValueError(f"descending {name} is not a number")
        parts += [(value.isNull() if desc else value.isNotNull()).alias(f"f{i}"),
                  (-value if desc else value).alias(f"v{i}")]
    return F.struct(*parts)


def literal(key: Row, kind: T.StructType) -> Column:
    return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kind.fields)])


@dataclass
class Target:
    """The ranks (from 0, ascending) that are looked for in one order.

    ``inside`` rows satisfy ``within``, and ``ranks`` count among them;
    ``slots`` are the places of the answers."""
    key: Column
    kind: T.StructType
    slots: list[tuple[int, int]]
    ranks: list[int]
    inside: int
    within: Column | None = None
    deviations: int = 4            # half of a bracket's width
    lows: list[Column | None] = field(default_factory=list)
    highs: list[Column | None] = field(default_factory=list)
    found: list[Row] | None = None

    def halves(self) -> list[Target]:
        middle = len(self.ranks) // 2
        return [replace(self, slots=self.slots[part], ranks=self.ranks[part])
                for part in (slice(None, middle), slice(middle, None))]

    @property
    def share(self) -> float:
        return min(1.0, SAMPLE_ROWS / self.inside)

    def _middle(self, rank: int) -> float:
        return (rank + 0.5) / self.inside

    def sampled(self, number: int) -> list[Column]:
        """Aggregates: the keys at the ends of each bracket, null where it is
        open, and the size of the sample."""
        chosen = F.col("_u") < F.lit(self.share)
        chosen = chosen if self.within is None else chosen & self.within
        keys = F.sort_array(F.collect_list(F.when(chosen, self.key)))
        size, out = F.size(keys), []
        for j, rank in enumerate(self.ranks):
            q = self._middle(rank)
            slack = F.lit(0) if self.share == 1 else F.ceil(
                F.sqrt(size * F.lit(q * (1 - q))) * self.deviations) + 2
            at = F.floor(size * F.lit(q))
            out += [F.when(at >= slack, F.get(keys, (at - slack).cast("int"))).alias(f"l{number}_{j}"),
                    F.get(keys, (at + slack).cast("int")).alias(f"h{number}_{j}")]
        return [*out, size.alias(f"n{number}")]

    def bracket(self, picked: Row, number: int) -> float:
        """Takes the brackets; about how many keys they hold."""
        def bound(name):
            return None if picked[name] is None else literal(picked[name], self.kind)

        self.lows = [bound(f"l{number}_{j}") for j in range(len(self.ranks))]
        self.highs = [bound(f"h{number}_{j}") for j in range(len(self.ranks))]
        size, keys = picked[f"n{number}"], 0.0
        for j, rank in enumerate(self.ranks):
            q, low, high = self._middle(rank), picked[f"l{number}_{j}"], picked[f"h{number}_{j}"]
            one = low is not None and low == high
            keys += 1 if one else \
                (2 * math.sqrt(size * q * (1 - q)) * self.deviations + 5) / self.share
        return keys

    def _placed(self) -> tuple[Column, Column]:
        """How many brackets end before a row, and whether it is in one."""
        ended, inside = F.lit(0), F.lit(False)
        for low, high in zip(self.lows, self.highs):
            here = F.lit(True)
            if low is not None:
                here = here & (self.key >= low)
            if high is not None:
                ended = ended + (self.key > high).cast("int")
                here = here & (self.key <= high)
            inside = inside | here
        return ended, inside

    def _rows(self, df: DataFrame) -> DataFrame:
        return df if self.within is None else df.filter(self.within)

    def narrow(self, df: DataFrame) -> bool:
        """Counts the rows and the distinct keys in and between the brackets
        and keeps the rows inside; False if that leaves too much."""
        ended, inside = self._placed()
        counts = self._rows(df).groupBy(ended.alias("_e")).agg(
            F.count_if(~inside).alias("_out"), F.count_if(inside).alias("_in"),
            F.approx_count_distinct(F.when(inside, self.key)).alias("_keys")).collect()
        held = sum(c["_in"] for c in counts)
        ranks = [r - sum(c["_out"] for c in counts if c["_e"] <= j) for j, r in enumerate(self.ranks)]
        if any(not 0 <= r < held for r in ranks):
            self.deviations *= 2                                 # a bracket missed its rank
            return True
        few = sum(c["_keys"] for c in counts) <= BRACKET_ROWS
        if not few and held > 0.9 * self.inside and len(ranks) > 1:
            return False
        self.ranks, self.inside = ranks, held
        self.within = inside if self.within is None else self.within & inside
        if few:
            self.lows = self.highs = [None] * len(ranks)         # all that is left
            self.pick(df)
        return True

    def pick(self, df: DataFrame) -> None:
        """The keys at the ranks, by ordering the keys in the brackets."""
        ended, inside = self._placed()
        keys = self._rows(df).groupBy(ended.alias("_e"), F.when(inside, self.key).alias("_k")) \
            .agg(F.count(F.lit(1)).alias("_m"))
        # about BRACKET_ROWS keys at most, and a row between two brackets
        running = keys.withColumn("_cum", F.sum("_m").over(
            Window.orderBy("_e", F.col("_k").asc_nulls_first())))
        row = running.agg(*[F.min(F.when(F.col("_cum") > r, F.struct("_e", "_k"))).alias(f"r{j}")
                            for j, r in enumerate(self.ranks)]).first()
        found = [r["_k"] if r else None for r in row]
        if all(k is not None for k in found):
            self.found = found
        else:
            self.deviations *= 2


def select_ranks(df: DataFrame, orders: Sequence[tuple[Order, Sequence[int], int]],
                 seed: int = 7) -> list[tuple[list[Row], T.StructType]]:
    """For each (order, ranks, rows): the sort keys of the rows at the given
    ranks (from 0, ascending) among the ``rows`` rows of ``df``, and the keys'
    type.  Rows that are equal in all columns of the order share a key.  All
    orders are sampled in one pass."""
    targets: list[Target] = []
    answers: list[tuple[list, T.StructType]] = []
    for i, (order, ranks, rows) in enumerate(orders):
        key = sort_key(df, order)
        kind = df.select(key.alias("k")).schema["k"].dataType
        answers.append(([None] * len(ranks), kind))
        if ranks:
            targets.append(Target(key, kind, [(i, j) for j in range(len(ranks))], list(ranks), rows))
    while targets:
        sampled = [c for i, t in enumerate(targets) for c in t.sampled(i)]
        picked = df.withColumn("_u", F.rand(seed)).agg(*sampled).first()
        still: list[Target] = []
        for i, target in enumerate(targets):
            if target.bracket(picked, i) <= BRACKET_ROWS:
                target.pick(df)
            elif not target.narrow(df):
                still += target.halves()
                continue
            if target.found is None:
                still.append(target)
            else:
                for (at, slot), key in zip(target.slots, target.found):
                    answers[at][0][slot] = key
        targets = still
        seed += 1
    return answers
