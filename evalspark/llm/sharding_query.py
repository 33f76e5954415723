"""Query 2: all documents in 40 shards of a region / rack / shard tree, and in one shard more."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.llm import sharding
from evalspark.llm.registry import query, table

TREE = sharding.even_tree(40)


def _descent_sql(tree: list[sharding.Leaf], name: str) -> str:
    """Three levels of draws for every row of ``d``, as common table expressions ending in ``name``."""
    steps, before = [], "d"
    for level, parent in (("region", None), ("rack", "region"), ("shard", "rack")):
        weights = sharding._weights(tree, parent, level)
        nodes = ", ".join(f"({p}, {n}, {float(w)})" for p, group in weights.items() for n, w in group.items())
        draw = f"-ln((CAST('0x' || substr(md5(k || '|{level}|' || node), 1, 13) AS BIGINT) + 1) / {float(1 << 52)}) / weight"
        on = f"n.parent = b.{parent}" if parent else "true"
        held = {"region": "", "rack": ", any_value(region) AS region", "shard": ""}[level]
        steps.append(
            f"{name}_{level} AS (SELECT r, any_value(k) AS k, arg_min(node, {draw}) AS {level}{held} FROM {before} b "
            f"JOIN (VALUES {nodes}) AS n(parent, node, weight) ON {on} GROUP BY r)"
        )
        before = f"{name}_{level}"
    return ",\n".join(steps)


_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(CAST(doc_id AS VARCHAR), '') AS k,
    encode(coalesce(text, '')) AS b FROM documents),
crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS UBIGINT)] || repeat([CAST(0 AS UBIGINT)], 8),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(CAST(3988292384 AS UBIGINT), a >> 1) ELSE a >> 1 END)) AS t),
crc AS (SELECT r, xor(CAST(4294967295 AS UBIGINT), list_reduce([CAST(4294967295 AS UBIGINT)] ||
    list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS UBIGINT)),
    lambda a, x: xor(t[CAST((xor(a, x) & 255) + 1 AS BIGINT)], a >> 8))) AS c FROM d, crc_table),
{_descent_sql(TREE, "now")},
{_descent_sql(sharding.grown(TREE), "later")}
SELECT d.doc_id, octet_length(b) + {sharding.RECORD_BYTES} AS size, CAST(c AS BIGINT) AS text_crc32, 'key' AS law,
    n.shard, row_number() OVER (PARTITION BY n.shard ORDER BY r) - 1 AS slot, l.shard AS grown_shard
FROM d JOIN crc USING (r) JOIN now_shard n USING (r) JOIN later_shard l USING (r)
"""


@query("op2_hash_tree_shards", _SQL)
def op2_hash_tree_shards(spark, sf):
    docs = sharding.with_size(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    placed = sharding.place(sharding.place(docs, TREE), sharding.grown(TREE), prefix="grown_")
    rows = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "grown_shard")
    return sharding.with_slots(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
