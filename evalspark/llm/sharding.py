"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level every child of the chosen node draws ``-ln(u) / weight`` with ``u`` taken from the digest of
``key | level | node``; the smallest draw wins. A child's draw depends on nothing but the key, its own name and its
own weight, so a changed weight moves rows only into or out of the subtrees whose weights change. Growth by one shard
opens a region of its own (:func:`grown`); then the only changed subtree is the new shard, and rows move into it alone.

Everything is column expressions. The digest is MD5 because any engine can repeat it.

Defined results: a null key counts as the empty key, equal keys share a shard, equal rows get slots of their own. A
null text has no bytes. Columns named like a result are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import ensure_checkpoint_dir

RECORD_BYTES = 16
_STEPS = 1 << 52  # 13 hex digits


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def even_tree(shards: int = 40, per_rack: int = 5, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 .. n-1 of equal weight, filled rack by rack and region by region."""
    return [Leaf(s // (per_rack * racks_per_region), s // per_rack, s) for s in range(shards)]


def grown(tree: Sequence[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, alone in a new rack of a new region."""
    return [*tree, Leaf(max(x.region for x in tree) + 1, max(x.rack for x in tree) + 1, max(x.shard for x in tree) + 1, weight)]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(f"|{level}|{node}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(_STEPS))
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(node).alias("node"))


def _choose(key: Column, level: str, weights: dict[int, float]) -> Column:
    draws = [_draw(key, level, node, weight) for node, weight in sorted(weights.items()) if weight > 0]
    if not draws:
        raise ValueError(f"no {level} has a positive weight")
    return (draws[0] if len(draws) == 1 else F.least(*draws))["node"]


def _descend(parent: Column, children: dict[int, dict[int, float]], key: Column, level: str) -> Column:
    """The winning child of whichever parent was chosen; only that parent's children draw."""
    out = None
    for node, weights in sorted(children.items()):
        if sum(weights.values()) <= 0:
            continue
        picked = _choose(key, level, weights)
        out = F.when(parent == node, picked) if out is None else out.when(parent == node, picked)
    return out


def _weights(tree: Sequence[Leaf], parent: str | None, child: str) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for leaf in tree:
        group = out.setdefault(getattr(leaf, parent) if parent else 0, {})
        node = getattr(leaf, child)
        group[node] = group.get(node, 0.0) + leaf.weight
    return out


def place(docs: DataFrame, tree: Sequence[Leaf], key: str = "doc_id", prefix: str = "") -> DataFrame:
    """``docs`` with ``region``, ``rack`` and ``shard`` (each with ``prefix``)."""
    name = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    return (
        docs.drop(region, rack, shard)
        .withColumn(region, _choose(name, "region", _weights(tree, None, "region")[0]))
        .withColumn(rack, _descend(F.col(region), _weights(tree, "region", "rack"), name, "rack"))
        .withColumn(shard, _descend(F.col(rack), _weights(tree, "rack", "shard"), name, "shard"))
    )


def with_slots(placed: DataFrame, shard: str = "shard") -> DataFrame:
    """``placed`` (narrow rows) with ``slot``: positions 0, 1, 2, ... inside each shard.

    The rows are checkpointed, which fixes their partitions. Each (shard, partition) pair is then numbered by itself
    and moved up by the rows of the shard in earlier partitions, so no task sees a whole shard. Only one count per
    pair is ever put in order.
    """
    from pyspark.sql import Window

    ensure_checkpoint_dir(placed.sparkSession)
    fixed = placed.drop("slot").checkpoint()
    # The row travels in a struct, so that no name of its own can clash.
    fixed = fixed.select(
        F.struct(*[F.col(f"`{c}`") for c in fixed.columns]).alias("row"), F.col(f"`{shard}`").alias("shard"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos"),
    )
    counts = fixed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("pos")) - 1
    return fixed.withColumn("rank", rank).join(offsets, ["shard", "part"]).select("row.*", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))


def with_size(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (bytes of the text and of its record head) and ``text_crc32``."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.drop("size", "text_crc32").withColumns(
        {
            "size": (F.octet_length(whole) + RECORD_BYTES).cast("long"),
            "text_crc32": F.crc32(whole.cast("binary")).cast("long"),
        }
    )
