"""Connected components of a link table, in rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import checkpointed, checkpointed_count


def _merged(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that stays between executors: node tables grow with the corpus,
    so none is broadcast through the driver, small as it may be."""
    return left.join(right.hint("merge"), on, how)


def _doubled(hooks: DataFrame) -> DataFrame:
    """Every node's hook's hook; ``moved`` where that is another one."""
    step = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return _merged(hooks.select("node", "root"), step, "root").select(
        "node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))


def renamed_links(links: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``links`` between the roots of their ends, each once, none inside one
    root; a node that ``roots`` does not know is its own root."""
    named = links.select("a", "b")
    if roots is not None:
        for end in ("a", "b"):
            names = roots.select(F.col("node").alias(end), F.col("root").alias("to"))
            named = _merged(named, names, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return named.filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _followed(roots: DataFrame, hooks: DataFrame, new: bool) -> DataFrame:
    """``roots`` followed along ``hooks``; ``new``: hooks may hold nodes that
    ``roots`` does not."""
    later = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
    followed = _merged(roots.select("node", "root"), later, "root", "left").select(
        "node", F.coalesce("next", "root").alias("root"))
    if not new:
        return followed
    return followed.union(_merged(hooks, roots.select("node"), "node", "left_anti"))


def component_roots(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (a, b) and of
    ``known``, the roots of links found before; two nodes have one root when
    they are connected.

    Each round hooks every node to its smallest neighbour, doubles the hooks
    until each leads to its end, and contracts the links to these ends; links
    inside one end go away.  Ends are smaller than all their neighbours, so at
    least one node of every link goes in a round, and a chain of any length
    goes in one, with as many doublings as its length has bits.  A round
    checkpoints twice: the hooks after two doublings (and after each further
    two that a long chain needs), and the links that are left.  Nothing but
    whether rows are left reaches the driver.
    """
    edges, left = renamed_links(links, known), 1
    if known is not None:       # links that are new between known roots are few, often none
        edges, left = checkpointed_count(edges)
    roots, rounds = known, 0
    while left:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("root"))
        moving = 1
        while moving:
            hooks, moving = checkpointed_count(_doubled(_doubled(hooks)), F.col("moved"))
            hooks = hooks.drop("moved")
        roots = hooks if roots is None else _followed(roots, hooks, new=rounds == 0)
        edges, left = checkpointed_count(renamed_links(edges, hooks))
        rounds += 1
    return checkpointed(roots) if rounds > (known is None) else roots
