"""Sharding by a hierarchical weighted hash tree (DataFrame operations only).

The shards are leaves of a tree: region, rack, shard.  A row descends from
the root; at each level every child draws an exponential number with the
child's weight as its rate, from a hash of (key, child), and the smallest
draw wins.  A child is chosen with probability weight / sum of weights, and
changing the weight of one child moves rows only into or out of that child:
all other draws stay as they were.  A weight change inside a rack therefore
moves rows only through that rack, its region, and the root.

The law is ``key``: the key and the tree decide the shard, nothing else.  A
shard that joins as a region of its own (:func:`grown`) changes no existing
weight, so it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, md5_fraction

#: Cells of a shard in which slots are counted; a cell is what one task sorts.
BLOCKS = 1024


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    per_region = shards_per_rack * racks_per_region
    return [Shard(s // per_region, s // shards_per_rack, s) for s in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a new region and a new rack."""
    return [*tree, Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1,
                         max(s.shard for s in tree) + 1, weight)]


def reweighted(tree: Sequence[Shard], shard: int, weight: float) -> list[Shard]:
    return [replace(s, weight=weight) if s.shard == shard else s for s in tree]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    return -F.log(md5_fraction(F.concat(key, F.lit(f"|{level}|{node}")))) / F.lit(float(weight))


def _winner(key: Column, level: str, weights: dict[int, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct(_draw(key, level, node, w).alias("draw"), F.lit(node).alias("node"))
             for node, w in sorted(weights.items())]
    return F.array_min(F.array(*draws))["node"]


def _weights(tree: Sequence[Shard], field: str) -> dict[int, float]:
    out: dict[int, float] = {}
    for s in tree:
        out[getattr(s, field)] = out.get(getattr(s, field), 0.0) + s.weight
    return out


def _choose(at: Column, branches: dict[int, Column]) -> Column:
    out = None
    for node, value in sorted(branches.items()):
        out = F.when(at == node, value) if out is None else out.when(at == node, value)
    return out


def with_shard(df: DataFrame, key_col: str, tree: Sequence[Shard], name: str = "shard") -> DataFrame:
    """Adds the shard that the tree gives each key.  A null key is a key like
    any other.  Shards of weight 0 take no rows; ``tree`` needs one with more.
    """
    live = [s for s in tree if s.weight > 0]
    if not live:
        raise ValueError("the tree has no shard with a weight")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    in_region = {r: [s for s in live if s.region == r] for r in _weights(live, "region")}
    in_rack = {r: [s for s in live if s.rack == r] for r in _weights(live, "rack")}
    region, rack = f"_{name}_region", f"_{name}_rack"
    return (df.withColumn(region, _winner(key, "region", _weights(live, "region")))
            .withColumn(rack, _choose(F.col(region), {
                r: _winner(key, "rack", _weights(part, "rack")) for r, part in in_region.items()}))
            .withColumn(name, _choose(F.col(rack), {
                r: _winner(key, "shard", _weights(part, "shard")) for r, part in in_rack.items()})
                .cast("int"))
            .drop(region, rack))


def with_slot(df: DataFrame, key_col: str, shard_col: str = "shard", name: str = "slot",
              blocks: int = BLOCKS) -> DataFrame:
    """Adds the row's place in its shard, from 0 and without gaps.

    The order is by the key's block (a hash), then by all columns.  No task
    sees a whole shard: a shard's rows are counted per block, the ``blocks``
    counts a shard are summed up in order, and rows are ordered inside a
    block.  Rows that are equal in every column are merged before the
    shuffle and dealt out again at the end, so repeated rows get neighbouring
    slots and cannot fill one task.  Give narrow rows: every column takes
    part in the grouping.
    """
    columns = list(df.columns)
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    block = F.floor(md5_fraction(F.concat(key, F.lit("|block"))) * blocks).cast("int")
    merged = checkpointed(df.withColumn("_block", block).groupBy(*columns, "_block")
                          .agg(F.count(F.lit(1)).alias("_copies")))
    earlier = Window.partitionBy(shard_col).orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x blocks rows: bounded by the parameters, not by the data
    cells = F.broadcast(
        merged.groupBy(shard_col, "_block").agg(F.sum("_copies").alias("_n"))
        .select(F.col(shard_col).alias("_shard"), F.col("_block").alias("_in_block"),
                F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")))
    inside = Window.partitionBy(shard_col, "_block").orderBy(key_col, *[
        c for c in columns if c != key_col]).rowsBetween(Window.unboundedPreceding, -1)
    placed = merged.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    first = F.col("_start") + F.col("_before")
    return (placed.join(cells, (F.col(shard_col) == F.col("_shard"))
                        & (F.col("_block") == F.col("_in_block")))
            .select(*columns, F.explode(F.sequence(first, first + F.col("_copies") - 1))
                    .alias(name)))


def shard_documents(docs: DataFrame, tree: Sequence[Shard], id_col: str = "doc_id",
                    text_col: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row per document: ``id``, ``size`` (UTF-8 bytes of the text, a null
    text has none, plus 8), ``text_crc32`` (of the UTF-8 bytes; 0 for null),
    ``shard``, ``slot`` and ``grown_shard``, the shard after one more joined.

    The text is read once, in the scan, and does not travel.  Other columns
    of ``docs`` are ignored.  An empty table gives an empty result.
    """
    sized = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long")
        .alias("text_crc32"))
    placed = with_shard(with_shard(sized, "id", tree), "id", grown(tree), "grown_shard")
    return with_slot(placed, "id", blocks=blocks)
