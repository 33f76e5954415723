"""Service payloads and service descriptions given as tables of JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that wrap the records of a payload, in order of preference.
WRAPPERS = ("data", "results", "items", "records", "value")
MAX_RECORDS, MAX_ENDPOINTS, MAX_TABLE_ROWS = 50, 10, 100


def payload_records(payload: Column) -> Column:
    """Array of variants in a payload: the array itself, the first wrapped array, or the single object.

    Text that is not JSON, and JSON that is neither array nor object, gives null.
    """
    parsed = F.try_parse_json(payload)
    arrays = [F.try_variant_get(parsed, "$", "array<variant>")]
    arrays += [F.try_variant_get(parsed, f"$.{w}", "array<variant>") for w in WRAPPERS]
    is_object = F.try_variant_get(parsed, "$", "map<string,variant>").isNotNull()
    return F.coalesce(*arrays, F.when(is_object, F.array(parsed)))


def unwrap_payloads(df: DataFrame, ids: list[str], payload: str = "payload", limit: int = MAX_RECORDS) -> DataFrame:
    """``ids, pos, record``: the first ``limit`` records of each payload."""
    exploded = df.select(*ids, F.posexplode(F.slice(payload_records(F.col(payload)), 1, limit)).alias("pos", "record"))
    return exploded


def list_endpoints(specs: DataFrame, ids: list[str], spec: str = "spec", limit: int = MAX_ENDPOINTS) -> DataFrame:
    """``ids, pos, path``: paths with a ``get`` and without parameters, the first ``limit`` in document order."""
    paths = F.get_json_object(spec, "$.paths")
    parsed = F.from_json(paths, "map<string,map<string,string>>")
    keys = F.filter(
        F.json_object_keys(paths),
        lambda p: F.try_element_at(F.try_element_at(parsed, p), F.lit("get")).isNotNull() & ~F.contains(p, F.lit("{")),
    )
    return specs.select(*ids, F.posexplode(F.slice(keys, 1, limit)).alias("pos", "path"))


def sample_tables(tables: dict[str, DataFrame], order_by: dict[str, str] | None = None, limit: int = MAX_TABLE_ROWS) -> DataFrame:
    """The first ``limit`` rows of each table, merged, with the table name in ``_source_table``.

    The limit is the feature (a sample per table). With ``order_by`` the sample is by key, otherwise
    whatever the source returns first.
    """
    if not tables:
        raise ValueError("no tables to sample")
    order_by = order_by or {}
    parts = [
        (df.orderBy(order_by[name]) if name in order_by else df).limit(limit).withColumn("_source_table", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sample_catalog(spark, database: str | None = None, names: list[str] | None = None, limit: int = MAX_TABLE_ROWS) -> DataFrame:
    """Sample every table of a catalog database (or the named ones)."""
    found = names or [t.name for t in spark.catalog.listTables(database)]
    prefix = f"`{database}`." if database else ""
    return sample_tables({n: spark.table(f"{prefix}`{n}`") for n in found}, limit=limit)
