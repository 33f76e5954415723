"""Connected components and greedy passes over links between items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators.joins import lookup_join
from evalspark.session import ensure_checkpoint_dir

# Links of a component that one task settles in a pass over sorted rows; it holds the dropped items of that component only.
PASS_LINKS = 1 << 20


def with_component(links: DataFrame) -> DataFrame:
    """``links(earlier, later)`` with ``component``, the least item that can be reached.

    Every round gives each item the least label among itself and its neighbours, then the label of that label, so that
    distances halve: rounds grow with the logarithm of the longest chain. Each is checkpointed.
    """
    ensure_checkpoint_dir(links.sparkSession)
    ends = links.select(F.col("earlier").alias("a"), F.col("later").alias("b"))
    ends = ends.union(ends.select("b", "a")).distinct().checkpoint()
    labels = ends.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).select("a", "label").checkpoint()
    live = ends
    while True:
        # What the labels say of links: the larger label hangs under the smaller one.
        own, other = labels.select("a", F.col("label").alias("own")), labels.select(F.col("a").alias("b"), F.col("label").alias("other"))
        met = live.join(own, "a").join(other, "b").filter(F.col("own") != F.col("other")).select("a", "b", "own", "other").checkpoint()
        if met.isEmpty():
            break
        hooks = met.groupBy(F.greatest("own", "other").alias("own")).agg(F.min(F.least("own", "other")).alias("under"))
        hooks = _roots(hooks.checkpoint())
        labels = (
            lookup_join(labels.withColumnRenamed("label", "own"), hooks, "own")
            .select("a", F.coalesce("under", "own").alias("label"))
            .checkpoint()
        )
        # Links inside a component are settled for good.
        live = met.select("a", "b")
    return links.join(labels.select(F.col("a").alias("later"), F.col("label").alias("component")), "later").select("earlier", "later", "component")


def _roots(hooks: DataFrame) -> DataFrame:
    """``hooks(own, under)``, each pointing to a smaller label, followed to their ends by doubling."""
    while True:
        after = hooks.select(F.col("own").alias("under"), F.col("under").alias("_next"))
        moved = lookup_join(hooks, after, "under").checkpoint()
        if moved.filter(F.col("_next").isNotNull()).isEmpty():
            return hooks
        hooks = moved.select("own", F.coalesce("_next", "under").alias("under"))


def _settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links sorted by (component, later) in, dropped items out."""
    component, item, beaten, dropped = None, None, False, set()

    for frame in frames:
        out = []
        for c, later, earlier in zip(frame["component"].tolist(), frame["later"].tolist(), frame["earlier"].tolist()):
            if item is not None and (c != component or later != item):
                if beaten:
                    out.append(item)
                    dropped.add(item)
                beaten = False
                if c != component:
                    dropped = set()
            component, item = c, later
            beaten = beaten or earlier not in dropped
        yield pd.DataFrame({"ord": out}, dtype="int64")
    if item is not None and beaten:
        yield pd.DataFrame({"ord": [item]}, dtype="int64")


def drop_linked_to_kept(links: DataFrame, pass_links: int = PASS_LINKS) -> DataFrame:
    """``ord`` of the items of ``links(earlier, later)`` that a greedy pass in their order drops: those linked to an earlier kept one.

    Links fall into components, and a component is settled in one pass over its sorted links. Components of more than
    ``pass_links`` links are settled by rounds over all of them at once.
    """
    ensure_checkpoint_dir(links.sparkSession)
    # Links are read twice, and finding them can be most of the work.
    parts = with_component(links.distinct().checkpoint()).checkpoint()
    sizes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("_links"))
    sized = lookup_join(parts, sizes, "component").checkpoint()
    order = ["component", "later"]
    small = sized.filter(F.col("_links") <= pass_links).select(*order, "earlier").repartition("component").sortWithinPartitions(*order)
    settled = small.mapInPandas(_settle, "ord long")
    large = sized.filter(F.col("_links") > pass_links).select("earlier", "later")
    if large.isEmpty():
        return settled
    return settled.unionAll(_drop_by_rounds(large))


def _drop_by_rounds(links: DataFrame) -> DataFrame:
    """The same for links of any number: per round all items without an open earlier neighbour stay, and their later neighbours go.

    A round works on the open links only and is checkpointed; there are as many as the longest chain of items that depend on each other.
    """
    open_links, dropped = links.checkpoint(), None
    while not open_links.isEmpty():
        kept = open_links.select("earlier").distinct().join(
            open_links.select(F.col("later").alias("earlier")).distinct(), "earlier", "left_anti"
        )
        now = open_links.join(kept, "earlier", "left_semi").select(F.col("later").alias("ord")).distinct().checkpoint()
        dropped = now if dropped is None else dropped.unionAll(now).checkpoint()
        open_links = (
            open_links.join(now.select(F.col("ord").alias("later")), "later", "left_anti")
            .join(now.select(F.col("ord").alias("earlier")), "earlier", "left_anti")
            .select("earlier", "later")
            .checkpoint()
        )
    return dropped
