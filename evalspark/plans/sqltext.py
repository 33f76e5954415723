"""Small builders for the SQL counterparts (plain text, no engine involved)."""

from __future__ import annotations

PART = [
    ("p_partkey", "int"), ("p_name", "str"), ("p_brand", "str"), ("p_type", "str"), ("p_size", "int"),
    ("p_retailprice", "dbl"),
]
CUSTOMER = [
    ("c_custkey", "int"), ("c_name", "str"), ("c_nationkey", "int"), ("c_acctbal", "dbl"), ("c_mktsegment", "str"),
]
SUPPLIER = [("s_suppkey", "int"), ("s_name", "str"), ("s_nationkey", "int"), ("s_acctbal", "dbl")]
ORDERS = [
    ("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "str"), ("o_totalprice", "dbl"),
    ("o_orderdate", "ts"), ("o_orderpriority", "str"),
]
LINEITEM = [
    ("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "dbl"),
    ("l_extendedprice", "dbl"), ("l_discount", "dbl"), ("l_tax", "dbl"), ("l_returnflag", "str"),
    ("l_linestatus", "str"), ("l_shipdate", "ts"),
]
KIND = {"int": "number", "dbl": "number", "str": "string", "ts": "date"}


def dbl(expr: str) -> str:
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%gZ')"


def text_of(column: str, kind: str) -> str:
    if kind == "int":
        return f"CAST({column} AS VARCHAR)"
    if kind == "dbl":
        return dbl(column)
    if kind == "ts":
        return ts(column)
    return column


def cells(source: str, columns: list[tuple[str, str]], index: str = "NULL") -> str:
    """``(ord, field, v, kind, num, t, idx)`` with one row per cell."""
    parts = []
    for i, (name, kind) in enumerate(columns):
        num = f"CAST({name} AS DOUBLE)" if kind in ("int", "dbl") else "CAST(NULL AS DOUBLE)"
        when = name if kind == "ts" else "CAST(NULL AS TIMESTAMP)"
        parts.append(
            f"SELECT {i} AS ord, '{name}' AS field, {text_of(name, kind)} AS v, '{KIND[kind]}' AS kind,"
            f" {num} AS num, {when} AS t, {index} AS idx FROM {source}"
        )
    return "\nUNION ALL\n".join(parts)


def stats(source: str, columns: list[tuple[str, str]], index: str = "NULL") -> str:
    return f"""SELECT ord, field, v, any_value(kind) AS kind, any_value(num) AS num, any_value(t) AS t,
  count(*) AS cnt, min(idx) AS first_idx FROM ({cells(source, columns, index)})
  WHERE v IS NOT NULL AND v <> '' GROUP BY ord, field, v"""


def profile(source: str, columns: list[tuple[str, str]]) -> str:
    return f"""SELECT ord, field,
  CASE WHEN count(v) = 0 THEN 'null' ELSE any_value(kind) END AS data_type,
  CAST(count(*) - count(v) AS BIGINT) AS null_count, CAST(count(DISTINCT v) AS BIGINT) AS unique_count,
  CAST(count(*) AS BIGINT) AS total_count,
  CASE WHEN any_value(kind) = 'number' THEN min(num) END AS num_min,
  CASE WHEN any_value(kind) = 'number' THEN max(num) END AS num_max,
  CASE any_value(kind) WHEN 'number' THEN {dbl('min(num)')} WHEN 'date' THEN {ts('min(t)')} END AS "min",
  CASE any_value(kind) WHEN 'number' THEN {dbl('max(num)')} WHEN 'date' THEN {ts('max(t)')} END AS "max"
FROM (SELECT ord, field, nullif(v, '') AS v, kind, num, t FROM ({cells(source, columns)})) GROUP BY ord, field"""
