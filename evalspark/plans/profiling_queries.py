"""Queries over row numbering, column profiles and fact selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import facts, incremental_profile, profiling
from evalspark.plans import sqltext as q
from evalspark.plans.registry import numbered, query, scan_table, table
from evalspark.session import scratch_path
from evalspark.sources.rowindex import with_row_index_by

PROFILE_FIELDS = ["field", "data_type", "null_count", "unique_count", "total_count", "min", "max"]
PROFILE_SQL = ", ".join(f'"{c}"' for c in PROFILE_FIELDS)

LINE_KEYS = [name for name, _ in q.LINEITEM]


@query("row_index_file_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS row_index FROM part")
def _(spark, sf):
    return numbered(spark, sf, "part").select("p_partkey", "row_index")


@query(
    "row_index_by_key",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY {', '.join(LINE_KEYS)}) - 1 AS row_index
    FROM lineitem""",
)
def _(spark, sf):
    return with_row_index_by(scan_table(spark, sf, "lineitem"), LINE_KEYS).select(
        "l_orderkey", "l_linenumber", "l_partkey", "row_index"
    )


@query("profile_part", f"SELECT {PROFILE_SQL} FROM ({q.profile('part', q.PART)})")
def _(spark, sf):
    return profiling.profile_columns(table(spark, sf, "part")).select(*PROFILE_FIELDS)


@query("profile_lineitem", f"SELECT {PROFILE_SQL} FROM ({q.profile('lineitem', q.LINEITEM)})")
def _(spark, sf):
    return profiling.profile_columns(scan_table(spark, sf, "lineitem")).select(*PROFILE_FIELDS)


@query("profile_date_range", f"SELECT {PROFILE_SQL} FROM ({q.profile('orders', q.ORDERS)}) WHERE data_type = 'date'")
def _(spark, sf):
    return profiling.profile_columns(table(spark, sf, "orders")).filter("data_type = 'date'").select(*PROFILE_FIELDS)


NULLED_PART = """(SELECT p_partkey, nullif(p_name, 'hot bolt') AS p_name, nullif(p_brand, 'Brand#2') AS p_brand,
  CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type END AS p_type, nullif(p_size, 7) AS p_size,
  CAST(NULL AS DOUBLE) AS p_retailprice FROM part)"""


def nulled_part(df):
    """Part with nulls and empty strings put in, because the given tables have none."""
    return df.selectExpr(
        "* except (p_name, p_brand, p_type, p_size, p_retailprice)",
        "nullif(p_name, 'hot bolt') AS p_name",
        "nullif(p_brand, 'Brand#2') AS p_brand",
        "if(p_type = 'PROMO', '', p_type) AS p_type",
        "nullif(p_size, 7) AS p_size",
        "cast(null AS double) AS p_retailprice",
    )


@query("profile_nulls", f"SELECT {PROFILE_SQL} FROM ({q.profile(NULLED_PART, q.PART)})")
def _(spark, sf):
    return profiling.profile_columns(nulled_part(table(spark, sf, "part"))).select(*PROFILE_FIELDS)


@query(
    "profile_nan",
    """SELECT 'l_extendedprice' AS field, 'number' AS data_type, CAST(0 AS BIGINT) AS null_count, CAST(count(DISTINCT CASE WHEN l_quantity % 5 = 0 THEN 'NaN' ELSE CAST(l_extendedprice AS VARCHAR) END) AS BIGINT) AS unique_count,
      CAST(count(*) AS BIGINT) AS total_count, min(CASE WHEN l_quantity % 5 <> 0 THEN l_extendedprice END) AS num_min, max(CASE WHEN l_quantity % 5 <> 0 THEN l_extendedprice END) AS num_max FROM lineitem""",
)
def _(spark, sf):
    price = F.when(F.col("l_quantity") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    found = profiling.profile_columns(scan_table(spark, sf, "lineitem").select(price.alias("l_extendedprice")))
    return found.select("field", "data_type", "null_count", "unique_count", "total_count", "num_min", "num_max")


# Two deliveries of files; the second update reads the new ones only. What sketches estimate is tested within its error.
@query("profile_incremental", f"SELECT field, data_type, null_count, total_count, \"min\", \"max\" FROM ({q.profile('lineitem', q.LINEITEM)})")
def _(spark, sf):
    source, store = scratch_path(spark, "profiled"), scratch_path(spark, "profile-parts")
    lines = scan_table(spark, sf, "lineitem")
    for part in (0, 1):
        lines.filter(F.col("l_orderkey") % 2 == part).write.mode("append").parquet(source)
        incremental_profile.update_profile(spark, source, store)
    return incremental_profile.profile_of_store(spark, store).select("field", "data_type", "null_count", "total_count", "min", "max")


TEXT_KIND_SQL = r"""CASE
  WHEN v IS NULL OR v = '' THEN NULL
  WHEN regexp_full_match(v, '\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?') AND try_cast(v AS TIMESTAMP) IS NOT NULL THEN 'date'
  WHEN regexp_full_match(v, '\d{1,2}/\d{1,2}/\d{4}') AND try_strptime(v, '%m/%d/%Y') IS NOT NULL THEN 'date'
  WHEN regexp_full_match(trim(v), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') THEN 'number'
  ELSE 'string' END"""


@query(
    "profile_text_kinds",
    f"""WITH src AS (
      SELECT CAST(event_id AS VARCHAR) AS id_text, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso_time,
        strftime(ts, '%-m/%-d/%Y') AS slash_date, CAST(round(value, 2) AS VARCHAR) AS amount, event_type AS label,
        CASE WHEN event_type = 'click' THEN event_type ELSE CAST(user_id AS VARCHAR) END AS blend,
        CASE WHEN event_type = 'view' THEN '2024-02-30' ELSE event_type END AS bad_date FROM events),
    long AS (UNPIVOT src ON id_text, iso_time, slash_date, amount, label, blend, bad_date INTO NAME field VALUE v)
    SELECT field, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) ELSE 'mixed' END AS data_type,
      CAST(count(DISTINCT v) AS BIGINT) AS unique_count
    FROM (SELECT field, v, {TEXT_KIND_SQL} AS kind FROM long) GROUP BY field""",
)
def _(spark, sf):
    src = table(spark, sf, "events").selectExpr(
        "cast(event_id AS string) AS id_text",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS iso_time",
        "date_format(ts, 'M/d/yyyy') AS slash_date",
        "cast(round(value, 2) AS string) AS amount",
        "event_type AS label",
        "if(event_type = 'click', event_type, cast(user_id AS string)) AS blend",
        "if(event_type = 'view', '2024-02-30', event_type) AS bad_date",
    )
    return profiling.profile_columns(src).select("field", "data_type", "unique_count")


@query(
    "profile_sample_values",
    f"""SELECT field, CAST(pos AS BIGINT) AS pos, v AS "value" FROM (
      SELECT field, v, row_number() OVER (PARTITION BY field ORDER BY first_idx) AS pos
      FROM ({q.stats('part', q.PART, 'p_partkey')})) WHERE pos <= 10""",
)
def _(spark, sf):
    return profiling.sample_values(profiling.value_stats(numbered(spark, sf, "part")))


@query(
    "profile_value_counts",
    f"""WITH s AS ({q.stats('customer', q.CUSTOMER, 'c_custkey')}
      UNION ALL {q.stats('part', q.PART, 'p_partkey')}),
    u AS (SELECT field FROM s WHERE kind = 'string' GROUP BY field HAVING count(*) <= 20)
    SELECT field, v AS "value", CAST(cnt AS BIGINT) AS cnt, CAST(first_idx AS BIGINT) AS first_idx
    FROM s WHERE field IN (SELECT field FROM u)""",
)
def _(spark, sf):
    found = [
        profiling.dataset_profile(numbered(spark, sf, name)).categories.select("field", "value", "cnt", "first_idx")
        for name in ("customer", "part")
    ]
    return found[0].unionAll(found[1])


@query(
    "profile_candidate_keys",
    f"""SELECT field FROM ({q.profile('orders', q.ORDERS)})
    WHERE unique_count / greatest(1, total_count - null_count) > 0.9 AND null_count < total_count * 0.05""",
)
def _(spark, sf):
    return profiling.candidate_keys(profiling.profile_columns(table(spark, sf, "orders"))).select("field")


@query(
    "profile_candidate_titles",
    f"""SELECT field FROM ({q.profile('part', q.PART)}) WHERE data_type = 'string'
    AND regexp_matches(regexp_replace(field, '^p_', ''), '(?i)^(name|title|label|description|display|subject|heading)')""",
)
def _(spark, sf):
    return profiling.candidate_titles(profiling.profile_columns(table(spark, sf, "part")), "^p_").select("field")


def _strata_sql(source: str, key: str, category: str, per: int) -> str:
    return f"""SELECT DISTINCT idx FROM (
      SELECT {key} AS idx, row_number() OVER (PARTITION BY {category} ORDER BY {key}) - 1 AS r,
        count(*) OVER (PARTITION BY {category}) AS m FROM {source}) x
      WHERE EXISTS (SELECT 1 FROM range({per}) t(j) WHERE j < least({per}, m) AND r = (j * m) // {per})"""


@query("profile_stratum_rows", f"SELECT idx AS row_index FROM ({_strata_sql('customer', 'c_custkey', 'c_mktsegment', 3)})")
def _(spark, sf):
    return profiling.rows_at_ranks(numbered(spark, sf, "customer"), "c_mktsegment", 3, block_rows=256)


@query(
    "profile_stratified_sample",
    f"""WITH n AS (SELECT count(*) AS total FROM part),
    s AS (SELECT idx FROM ({_strata_sql('part', 'p_partkey', 'p_type', 3)})
      UNION SELECT 0 UNION SELECT total - 1 FROM n),
    r AS (SELECT 20 - count(*) AS missing FROM s),
    even AS (SELECT i FROM (SELECT unnest(range(0, total, greatest(1, total // greatest(1, missing)))) AS i, missing
        FROM n, r) WHERE missing > 0 AND i NOT IN (SELECT idx FROM s) ORDER BY i LIMIT (SELECT greatest(0, missing) FROM r)),
    s2 AS (SELECT idx FROM s UNION SELECT i FROM even),
    free AS (SELECT p_partkey AS i FROM part WHERE p_partkey NOT IN (SELECT idx FROM s2) ORDER BY 1
        LIMIT (SELECT greatest(0, 20 - count(*)) FROM s2))
    SELECT p_partkey, p_name, p_type FROM part
    WHERE p_partkey IN (SELECT idx FROM s2 UNION SELECT i FROM free)""",
)
def _(spark, sf):
    df = numbered(spark, sf, "part")
    return profiling.stratified_sample(df, profiling.profile_columns(df)).select("p_partkey", "p_name", "p_type")


# --- facts -----------------------------------------------------------------------------------------

_EXTREMES = """SELECT field, min(CASE WHEN num = lo THEN first_idx END) AS min_row,
      min(CASE WHEN num = hi THEN first_idx END) AS max_row
    FROM (SELECT *, min(num) OVER (PARTITION BY field) AS lo, max(num) OVER (PARTITION BY field) AS hi
      FROM ({stats}) WHERE kind = 'number') GROUP BY field"""
_LINES = f"""(SELECT *, row_number() OVER (ORDER BY {', '.join(LINE_KEYS)}) - 1 AS rn FROM lineitem)"""


@query("fact_extreme_rows", _EXTREMES.format(stats=q.stats(_LINES, q.LINEITEM, "rn")))
def _(spark, sf):
    df = with_row_index_by(scan_table(spark, sf, "lineitem"), LINE_KEYS)
    profile = profiling.dataset_profile(df)
    return facts.extreme_rows(profile.stats, profile.columns)


_RARE_COMMON = """SELECT field, 'rarest' AS role, v AS "value", first_idx FROM (
      SELECT *, row_number() OVER (PARTITION BY field ORDER BY cnt, first_idx) AS p FROM cat) WHERE p = 1
    UNION ALL
    SELECT field, 'most_common', v, first_idx FROM (
      SELECT *, row_number() OVER (PARTITION BY field ORDER BY cnt DESC, first_idx DESC) AS p,
        count(*) OVER (PARTITION BY field) AS n FROM cat) WHERE p = 1 AND n > 1"""


@query(
    "fact_rare_and_common_rows",
    f"""WITH s AS ({q.stats('customer', q.CUSTOMER, 'c_custkey')}),
    cat AS (SELECT * FROM s WHERE kind = 'string' AND field IN (SELECT field FROM s GROUP BY field HAVING count(*) <= 20))
    {_RARE_COMMON}""",
)
def _(spark, sf):
    return facts.rare_and_common_rows(profiling.dataset_profile(numbered(spark, sf, "customer")).categories)


@query(
    "fact_null_rows",
    f"""SELECT field, min(idx) AS first_idx FROM ({q.cells(NULLED_PART, q.PART, 'p_partkey')})
    WHERE v IS NULL OR v = '' GROUP BY ord, field ORDER BY ord LIMIT 3""",
)
def _(spark, sf):
    return facts.null_rows(nulled_part(numbered(spark, sf, "part")).select(*[n for n, _ in q.PART], "row_index"))


_SELECTED = f"""s AS ({q.stats('part', q.PART, 'p_partkey')}),
    ext AS ({_EXTREMES.format(stats='SELECT * FROM s')}),
    cat AS (SELECT * FROM s WHERE kind = 'string' AND field IN (SELECT field FROM s GROUP BY field HAVING count(*) <= 20)),
    pri AS (SELECT min_row AS idx FROM ext UNION SELECT max_row FROM ext UNION SELECT first_idx FROM ({_RARE_COMMON})),
    goal AS (SELECT (SELECT count(*) FROM part) AS n, least((SELECT count(*) FROM part), 34) - (SELECT count(*) FROM pri) AS missing),
    fill AS (SELECT p_partkey AS idx FROM part, goal
      WHERE p_partkey % greatest(1, n // greatest(1, missing)) = 0 AND p_partkey NOT IN (SELECT idx FROM pri)
      ORDER BY p_partkey LIMIT (SELECT greatest(0, missing) FROM goal)),
    sel AS (SELECT idx FROM pri UNION SELECT idx FROM fill)"""


@query("fact_spread_rows", f"WITH {_SELECTED} SELECT idx AS row_index FROM fill")
def _(spark, sf):
    df = numbered(spark, sf, "part")
    profile = profiling.dataset_profile(df)
    return facts.spread_rows(facts.priority_rows(df, profile), df.agg(F.count(F.lit(1))).scalar(), facts.target_rows(6))


@query("fact_selected_rows", f"WITH {_SELECTED} SELECT idx AS row_index FROM sel")
def _(spark, sf):
    df = numbered(spark, sf, "part")
    return facts.selected_rows(df, profiling.dataset_profile(df))


FACTS_SQL = f"""{_SELECTED},
    fact AS (SELECT row_number() OVER (ORDER BY idx, ord) AS fact_no, field, v AS "value", kind, idx AS row_index,
      'part.parquet:row ' || CAST(idx + 1 AS VARCHAR) AS row_ref
      FROM ({q.cells('part', q.PART, 'p_partkey')}) WHERE v IS NOT NULL AND v <> '' AND idx IN (SELECT idx FROM sel)),
    facts AS (SELECT * FROM fact WHERE fact_no <= 200)"""


def part_facts(spark, sf):
    df = numbered(spark, sf, "part")
    return facts.extract_facts(df, profiling.dataset_profile(df), "part.parquet")


@query(
    "fact_emission",
    f"""WITH {FACTS_SQL} SELECT 'f-' || CAST(fact_no AS VARCHAR) AS fact_id, CAST(fact_no AS BIGINT) AS fact_no, field,
    "value", row_index, row_ref FROM facts""",
)
def _(spark, sf):
    return part_facts(spark, sf)


@query(
    "fact_groups",
    f"""WITH {FACTS_SQL} SELECT row_ref, CAST(min(fact_no) AS BIGINT) AS first_fact, CAST(count(*) AS BIGINT) AS facts,
    string_agg(field || '=' || "value", ' | ' ORDER BY fact_no) AS listed FROM facts GROUP BY row_ref""",
)
def _(spark, sf):
    return facts.facts_by_record(part_facts(spark, sf)).select(
        "row_ref",
        "first_fact",
        F.size("facts").cast("bigint").alias("facts"),
        F.array_join(F.transform("facts", lambda f: F.concat(f["field"], F.lit("="), f["value"])), " | ").alias("listed"),
    )


@query(
    "fact_summary",
    f"""WITH {FACTS_SQL}, line AS (
      SELECT row_ref, min(fact_no) AS first_fact,
        string_agg(field || '=' || CASE WHEN kind = 'number' THEN "value" ELSE '"' || "value" || '"' END, ', ' ORDER BY fact_no) AS body
      FROM facts GROUP BY row_ref)
    SELECT CAST(record_no AS BIGINT) AS record_no, '[' || row_ref || '] ' || body AS line FROM (
      SELECT *, row_number() OVER (ORDER BY first_fact) AS record_no FROM line) WHERE record_no <= 15""",
)
def _(spark, sf):
    return facts.summarize_facts(part_facts(spark, sf), ["p_partkey", "p_size", "p_retailprice"])
