"""Queries over question generation, grounding, validation and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.text import normalize_prompt
from evalspark.operators import diagnostics, grounding, profiling, questions, validation
from evalspark.plans import drafts as d
from evalspark.plans import profiling_queries as pq
from evalspark.plans import sqltext as q
from evalspark.plans.registry import numbered, query, table
from evalspark.session import scratch_path

WEIGHTS = ", ".join(f"({i}, '{c}', {w})" for i, (c, w) in enumerate(questions.CATEGORY_WEIGHTS.items()))


def _draft_sql(body: str) -> str:
    return f"SELECT {d.DRAFT_COLUMNS} FROM ({body})"


@query(
    "question_quotas",
    f"""SELECT i AS category_pos, c AS category, CAST(greatest(1, round((SELECT count(*) FROM part) * w)) AS BIGINT) AS quota
    FROM (VALUES {WEIGHTS}) AS t(i, c, w)""",
)
def _(spark, sf):
    return questions.category_quotas(spark, table(spark, sf, "part").count())


@query(
    "question_schema_lines",
    f"""WITH p AS ({q.profile('part', q.PART)}), s AS ({q.stats('part', q.PART, 'p_partkey')}),
    c AS (SELECT field, string_agg(v, ', ' ORDER BY first_idx) AS shown FROM (
      SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_idx) AS r, count(*) OVER (PARTITION BY field) AS n
      FROM s WHERE kind = 'string') WHERE n <= 20 AND r <= 5 GROUP BY field)
    SELECT ord, p.field || ' (' || data_type || ', ' || CAST(unique_count AS VARCHAR) || ' unique, ' || CAST(null_count AS VARCHAR)
      || ' nulls' || coalesce(', categories: ' || shown, '') || ')' AS line FROM p LEFT JOIN c ON c.field = p.field""",
)
def _(spark, sf):
    profile = profiling.dataset_profile(numbered(spark, sf, "part"))
    return questions.describe_schema(profile.columns, profile.categories)


# Intents over every part: by row reference; every third refers to a row that no fact covers.
_INTENTS = """SELECT p_partkey AS intent, CASE WHEN p_partkey % 3 = 0 THEN ['elsewhere:row 1']
      ELSE ['part.parquet:row ' || CAST(p_partkey + 1 AS VARCHAR), 'part.parquet:row 1'] END AS refs,
    CASE WHEN p_partkey % 2 = 0 THEN ['p_type', 'p_size'] ELSE ['p_name'] END AS fields FROM part"""
_CONTEXT = f"""{pq.FACTS_SQL}, intents AS ({_INTENTS}),
    r AS (SELECT intent, unnest(refs) AS row_ref, generate_subscripts(refs, 1) - 1 AS pos FROM intents),
    by_row AS (SELECT intent, pos, fact_no FROM r JOIN facts USING (row_ref)),
    lead5 AS (SELECT field, fact_no FROM (SELECT field, fact_no, row_number() OVER (PARTITION BY field ORDER BY fact_no) AS n FROM facts) WHERE n <= 5),
    f AS (SELECT intent, unnest(fields) AS field, generate_subscripts(fields, 1) - 1 AS pos FROM intents
      WHERE intent NOT IN (SELECT intent FROM by_row)),
    ctx AS (SELECT * FROM by_row UNION ALL SELECT intent, pos, fact_no FROM f JOIN lead5 USING (field))"""


def _intents(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS intent",
        "if(p_partkey % 3 = 0, array('elsewhere:row 1'), array(concat('part.parquet:row ', p_partkey + 1), 'part.parquet:row 1')) AS target_row_references",
        "if(p_partkey % 2 = 0, array('p_type', 'p_size'), array('p_name')) AS target_fields",
    )


@query("question_intent_context", f"WITH {_CONTEXT} SELECT intent, CAST(pos AS INTEGER) AS pos, CAST(fact_no AS BIGINT) AS fact_no FROM ctx")
def _(spark, sf):
    return questions.intent_context(_intents(spark, sf), pq.part_facts(spark, sf))


@query(
    "question_context_attachment",
    f"""WITH {_CONTEXT} SELECT p_partkey AS draft, p_name AS prompt,
      (SELECT string_agg(CAST(fact_no AS VARCHAR), ',' ORDER BY pos, fact_no) FROM ctx WHERE intent = p_partkey) AS fact_list FROM part""",
)
def _(spark, sf):
    drafted = table(spark, sf, "part").selectExpr("p_partkey AS draft", "p_name AS prompt")
    context = questions.intent_context(_intents(spark, sf), pq.part_facts(spark, sf))
    return questions.attach_context(drafted, context).select(
        "draft", "prompt", F.array_join(F.col("referenced_facts").cast("array<string>"), ",").alias("fact_list")
    )


@query("question_single_record", _draft_sql(d.SUPPLIER.single(["s_nationkey", "s_acctbal"])))
def _(spark, sf):
    return d.flat(questions.single_record_questions(d.supplier(spark, sf), ["s_nationkey", "s_acctbal"]))


@query("question_attribute", _draft_sql(d.PART.attribute(d.PART_FIELDS)))
def _(spark, sf):
    return d.flat(questions.attribute_questions(d.part(spark, sf), d.PART_FIELDS))


@query("question_filtered_find", _draft_sql(d.CUSTOMER.filtered(["c_mktsegment"])))
def _(spark, sf):
    return d.flat(questions.filtered_find_questions(d.customer(spark, sf), ["c_mktsegment"]))


@query("question_temporal", _draft_sql(d.ORDERS.temporal("o_orderdate")))
def _(spark, sf):
    return d.flat(questions.temporal_questions(d.orders(spark, sf), "o_orderdate"))


@query("question_comparison", _draft_sql(d.PART.comparison("p_type", "p_retailprice")))
def _(spark, sf):
    return d.flat(questions.comparison_questions(d.part(spark, sf), "p_type", "p_retailprice", block_rows=300))


@query(
    "question_filtered_members",
    """SELECT 'c_mktsegment' AS field, c_mktsegment AS "value", row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_name, c_custkey) AS rank,
    c_name AS entity FROM customer""",
)
def _(spark, sf):
    return questions.filtered_find_members(d.customer(spark, sf), ["c_mktsegment"]).drop("row_index")


@query("question_edge_case", _draft_sql(d.PLACES.edge("r_name", "n_name")))
def _(spark, sf):
    return d.flat(questions.edge_case_questions(d.customer_places(spark, sf), "r_name", "n_name"))


# Both domains have more than twenty values.
@query("question_edge_case_wide", _draft_sql(d.PART.edge("p_name", "p_brand")))
def _(spark, sf):
    return d.flat(questions.edge_case_questions(d.part(spark, sf), "p_name", "p_brand"))


@query(
    "question_quota_selection",
    f"""WITH a AS ({d.ALL_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS n FROM a)
    SELECT r.ord, r.category, r.prompt FROM r JOIN (VALUES {WEIGHTS}) AS t(i, c, w) ON c = category WHERE n <= greatest(1, round(30 * w))""",
)
def _(spark, sf):
    return questions.apply_quotas(d.all_drafts(spark, sf)).select("ord", "category", "prompt")


# Replies built around each event's properties in every form a model uses, some without any JSON.
@query(
    "question_reply_extraction",
    """SELECT event_id, CAST(u.pos AS INTEGER) AS pos, u.prompt, u.facts FROM events e, LATERAL (VALUES
      ('click', 0, 'k?', 'a=1'), ('view', 0, 'one', ''), ('view', 1, 'two', ''), ('purchase', 0, 'p', '')) AS u(t, pos, prompt, facts)
    WHERE u.t = e.event_type""",
)
def _(spark, sf):
    replies = table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_type
          WHEN 'click' THEN concat('\x1b[31m{"questions": [{"prompt": "k?", "category": "temporal", "expected_answer": ', props, ', "supporting_facts": ["a=1"]}]}\x1b[0m')
          WHEN 'view' THEN 'Here: ```json {"questions": [{"prompt": "one"}, {"prompt": "two"}]} ``` done'
          WHEN 'purchase' THEN 'Sure! {"questions": [{"prompt": "p", "source_location": "x:row 1"}]} Bye.'
          WHEN 'error' THEN concat('no json ', props)
          ELSE 'nothing here' END AS reply""",
    )
    return questions.explode_reply(replies, ["event_id"]).select(
        "event_id", "pos", "prompt", F.coalesce(F.array_join("supporting_facts", "|"), F.lit("")).alias("facts")
    )


# --- grounding -------------------------------------------------------------------------------------

# Imperfect drafts for every part: quoted, differently cased, wrong, unknown and malformed facts.
_LOOSE = """SELECT p_partkey AS ord, p_brand, p_type, p_size, p_partkey,
    CASE p_partkey % 4 WHEN 0 THEN 'part.parquet:row ' || CAST(p_partkey + 1 AS VARCHAR) WHEN 1 THEN 'X:ROW  ' || CAST(p_partkey + 1 AS VARCHAR) || ' end'
      WHEN 2 THEN 'no reference' ELSE 'p:row ' || CAST(p_partkey + 1000000000 AS VARCHAR) END AS loc,
    CASE WHEN p_partkey % 5 = 0 THEN ['p_size=-1'] ELSE
      ['p_brand="' || p_brand || '"', ' p_type = ' || lower(p_type), 'p_size=-1', 'nofield=1', 'malformed', 'p_partkey=' || CAST(p_partkey AS VARCHAR)] END AS given FROM part"""


def _loose(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS ord",
        """CASE p_partkey % 4 WHEN 0 THEN concat('part.parquet:row ', p_partkey + 1) WHEN 1 THEN concat('X:ROW  ', p_partkey + 1, ' end')
          WHEN 2 THEN 'no reference' ELSE concat('p:row ', p_partkey + 1000000000) END AS source_location""",
        """if(p_partkey % 5 = 0, array('p_size=-1'), array(concat('p_brand="', p_brand, '"'), concat(' p_type = ', lower(p_type)), 'p_size=-1', 'nofield=1',
          'malformed', concat('p_partkey=', p_partkey))) AS supporting_facts""",
    )


@query(
    "ground_row_reference",
    f"SELECT ord, CASE WHEN regexp_matches(loc, '(?i):row\\s*\\d+') THEN CAST(regexp_extract(loc, '(?i):row\\s*(\\d+)', 1) AS BIGINT) - 1 END AS row_index FROM ({_LOOSE})",
)
def _(spark, sf):
    return _loose(spark, sf).select("ord", grounding.referenced_row(F.col("source_location")).alias("row_index"))


@query(
    "ground_facts",
    f"""SELECT ord, CASE WHEN ord % 4 IN (0, 1) THEN 'part.parquet:row ' || CAST(ord + 1 AS VARCHAR) ELSE loc END AS source_location,
      CASE WHEN ord % 4 IN (0, 1) AND ord % 5 <> 0 THEN 'p_brand=' || p_brand || ' | p_type=' || p_type || ' | p_partkey=' || CAST(p_partkey AS VARCHAR)
        ELSE array_to_string(given, ' | ') END AS facts FROM ({_LOOSE})""",
)
def _(spark, sf):
    grounded = grounding.ground_answers(_loose(spark, sf), numbered(spark, sf, "part"), "part.parquet")
    return grounded.select("ord", "source_location", F.array_join("supporting_facts", " | ").alias("facts"))


_VALUE = """regexp_replace(trim(substring(f, instr(f, '=') + 1)), '^"|"$', '', 'g')"""
# Answers that quote only some of the facts.
_PARTIAL = f"""SELECT ord, CASE ord % 3 WHEN 0 THEN 'Brand ' || p_brand || ' and type ' || p_type || '.' WHEN 1 THEN upper(p_brand) ELSE '' END AS answer,
    CASE WHEN ord % 7 = 0 THEN [] ELSE given END AS given FROM ({_LOOSE})"""


def _partial(spark, sf):
    loose = _loose(spark, sf).join(table(spark, sf, "part").withColumnRenamed("p_partkey", "ord"), "ord")
    return loose.selectExpr(
        "ord",
        "CASE ord % 3 WHEN 0 THEN concat('Brand ', p_brand, ' and type ', p_type, '.') WHEN 1 THEN upper(p_brand) ELSE '' END AS expected_answer",
        "if(ord % 7 = 0, array(), supporting_facts) AS supporting_facts",
        "concat('q', ord) AS prompt",
        "'part.parquet:row 1' AS source_location",
        "'temporal' AS category",
        "'easy' AS difficulty",
    )


@query(
    "ground_confidence",
    f"""SELECT ord, CASE WHEN len(given) = 0 THEN 'low' WHEN share >= 0.8 THEN 'high' WHEN share >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM (
      SELECT ord, given, len(list_filter(given, lambda f: instr(f, '=') > 0 AND {_VALUE} <> '' AND contains(lower(answer), lower({_VALUE})))) / len(given) AS share FROM ({_PARTIAL}))""",
)
def _(spark, sf):
    return grounding.build_items(_partial(spark, sf)).select("ord", F.col("grounding_confidence").alias("confidence"))


@query(
    "ground_assertions",
    f"""SELECT ord, CAST(pos - 1 AS INTEGER) AS pos, v AS "value", length(v) < 5 AND regexp_full_match(v, '[a-zA-Z]+') AS whole_word FROM (
      SELECT ord, unnest(vs) AS v, generate_subscripts(vs, 1) AS pos FROM (
        SELECT ord, list_filter(list_transform(list_filter(given, lambda f: instr(f, '=') > 0), lambda f: {_VALUE}),
          lambda v: length(v) BETWEEN 2 AND 80 AND contains(lower(answer), lower(v))) AS vs FROM ({_PARTIAL})))""",
)
def _(spark, sf):
    items = grounding.build_items(_partial(spark, sf)).select("ord", F.posexplode("assertions").alias("pos", "a"))
    return items.select("ord", "pos", "a.value", F.coalesce("a.whole_word", F.lit(False)).alias("whole_word"))


# Every word of a text as a fact: distinct, then the first five.
@query(
    "ground_assertion_limit",
    """SELECT doc_id, CAST(pos AS INTEGER) AS pos, v AS "value" FROM (
      SELECT doc_id, v, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM (
        SELECT doc_id, v, min(i) AS i FROM (
          SELECT doc_id, unnest(w) AS v, generate_subscripts(w, 1) AS i FROM (
            SELECT doc_id, string_split(text, ' ') AS w FROM documents))
        WHERE length(v) BETWEEN 2 AND 80 AND v NOT LIKE '%"%' AND v = trim(v, ' ' || chr(10) || chr(9) || chr(13)) GROUP BY doc_id, v)) WHERE pos < 5""",
)
def _(spark, sf):
    words = F.split("text", " ")
    facts_of = F.transform(
        F.filter(words, lambda w: ~F.contains(w, F.lit('"')) & (w == F.btrim(w, F.lit(" \n\t\r")))),
        lambda w: F.concat(F.lit("word="), w),
    )
    derived = grounding.derive_assertions(facts_of, F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(derived).alias("pos", "a")).select("doc_id", "pos", "a.value")


# Orders in sixteen files, and references that lie in two of them: only those are read.
@query(
    "ground_pruned_files",
    """SELECT s_suppkey AS ord, 'orders:row ' || CAST(s_suppkey + 1 AS VARCHAR) AS source_location, 'o_orderstatus=' || o_orderstatus AS facts FROM supplier JOIN
      (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, * FROM orders) ON n = s_suppkey + 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "orders-files")
    table(spark, sf, "orders").repartitionByRange(16, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    drafts = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("ord"), F.concat(F.lit("x:row "), F.col("s_suppkey") + 1).alias("source_location"),
        F.array(F.lit("o_orderstatus=F"), F.lit("o_orderstatus=O"), F.lit("o_orderstatus=P")).alias("supporting_facts"),
    )
    grounded = grounding.ground_in_files(drafts, spark.read.parquet(path), "orders")
    return grounded.select("ord", "source_location", F.array_join("supporting_facts", " | ").alias("facts"))


_ITEM_ID = "substring(sha256(prompt || '|' || source_location), 1, 12)"


@query(
    "ground_items",
    f"""SELECT {_ITEM_ID} AS id, ord, prompt, expected_answer, source_location, category, difficulty,
      array_to_string(facts, ' | ') AS facts FROM ({d.ALL_SQL})""",
)
def _(spark, sf):
    return grounding.build_items(d.all_drafts(spark, sf)).select(
        "id", "ord", "prompt", "expected_answer", "source_location", "category", "difficulty",
        F.array_join("supporting_facts", " | ").alias("facts"),
    )


# --- validation ------------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g'))"
_TURNS = "SELECT 'c' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS id, text FROM conversations"


@query(
    "dedup_normalized",
    f"SELECT id, {_NORM} AS norm FROM ({_TURNS} UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), text FROM documents)",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").selectExpr("concat('c', conv_id, '.', turn) AS id", "text")
    docs = table(spark, sf, "documents").selectExpr("concat('d', doc_id) AS id", "text")
    return turns.unionAll(docs).select("id", normalize_prompt(F.col("text")).alias("norm"))


@query("dedup_exact", f"SELECT min(doc_id) AS ord FROM (SELECT doc_id, {_NORM} AS norm FROM documents) GROUP BY norm")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), normalize_prompt(F.col("text")).alias("norm"))
    return validation.first_ords(docs)


# Every document twice: as it is, and with its source and number added at both ends.
_VARIANTS = """SELECT doc_id * 2 AS ord, text FROM documents UNION ALL
    SELECT doc_id * 2 + 1, source || ' ' || text || ' copy ' || CAST(doc_id % 10 AS VARCHAR) FROM documents"""
_DISTINCT = f"SELECT min(ord) AS ord, norm, length(norm) AS n FROM (SELECT ord, {_NORM} AS norm FROM ({_VARIANTS})) GROUP BY norm"
_PAIRS = f"""texts AS ({_DISTINCT}), pairs AS (SELECT s.ord AS short_ord, l.ord AS long_ord FROM texts s JOIN texts l
    ON s.n < l.n AND s.n * 5 > l.n * 4 AND contains(l.norm, s.norm))"""


def _variants(spark, sf):
    docs = table(spark, sf, "documents")
    plain = docs.selectExpr("doc_id * 2 AS ord", "text")
    longer = docs.selectExpr("doc_id * 2 + 1 AS ord", "concat(source, ' ', text, ' copy ', doc_id % 10) AS text")
    return plain.unionAll(longer)


def _variant_norms(spark, sf):
    normed = _variants(spark, sf).select("ord", normalize_prompt(F.col("text")).alias("norm"))
    return validation.first_of_equal(normed)


@query("dedup_near_pairs", f"WITH {_PAIRS} SELECT * FROM pairs")
def _(spark, sf):
    return validation.near_duplicate_pairs(_variant_norms(spark, sf))


_FOLD = """edges AS (SELECT least(short_ord, long_ord) AS e, greatest(short_ord, long_ord) AS l FROM pairs),
    nodes AS (SELECT l AS ord, list(e) AS nbr FROM edges GROUP BY l UNION ALL SELECT DISTINCT e, CAST([] AS BIGINT[]) FROM edges WHERE e NOT IN (SELECT l FROM edges)),
    fold AS (SELECT list_reduce(list(list_concat([ord], nbr) ORDER BY ord),
      lambda acc, x: CASE WHEN list_has_any(acc, x[2:]) THEN acc ELSE list_append(acc, x[1]) END, CAST([] AS BIGINT[])) AS kept FROM nodes),
    dropped AS (SELECT ord FROM nodes, fold WHERE NOT list_contains(kept, ord))"""
_GREEDY = f"{_PAIRS}, {_FOLD}"


@query("dedup_resolution", f"WITH {_GREEDY} SELECT ord FROM dropped")
def _(spark, sf):
    return validation.resolve_keep_first(validation.near_duplicate_pairs(_variant_norms(spark, sf)))


@query("dedup_kept_items", f"WITH {_GREEDY} SELECT ord FROM texts WHERE ord NOT IN (SELECT ord FROM dropped)")
def _(spark, sf):
    return validation.deduplicate(_variants(spark, sf), "text").select("ord")


# All drafts as items, validated against the rows of the part table.
_CONF = f"""CASE WHEN len(facts) = 0 THEN 'low' ELSE (SELECT CASE WHEN s >= 0.8 THEN 'high' WHEN s >= 0.4 THEN 'medium' ELSE 'low' END FROM (
    SELECT len(list_filter(facts, lambda f: contains(lower(expected_answer), lower({_VALUE})))) / len(facts) AS s)) END"""
_ITEMS = f"items AS (SELECT *, {_CONF} AS confidence FROM ({d.ALL_SQL}))"


def all_items(spark, sf):
    return grounding.build_items(d.all_drafts(spark, sf))


@query(
    "validate_balance",
    f"""WITH {_ITEMS} SELECT i AS category_pos, c AS category, CAST((SELECT count(*) FROM items WHERE category = c) AS BIGINT) AS "items"
    FROM (VALUES {WEIGHTS}) AS t(i, c, w)""",
)
def _(spark, sf):
    return validation.category_balance(all_items(spark, sf)).select("category_pos", "category", "items")


_BALANCE_ISSUE = """'Category "' || c || '" is ' || CASE WHEN share < w THEN 'under' ELSE 'over' END || '-represented ('
      || CAST(CAST(round(share * 100) AS BIGINT) AS VARCHAR) || '% vs ' || CAST(CAST(round(w * 100) AS BIGINT) AS VARCHAR) || '% target)'"""


@query(
    "validate_balance_issues",
    f"""WITH {_ITEMS} SELECT i AS category_pos, {_BALANCE_ISSUE} AS issue FROM (
      SELECT i, c, w, (SELECT count(*) FROM items WHERE category = c) / (SELECT count(*) FROM items) AS share
      FROM (VALUES {WEIGHTS}) AS t(i, c, w)) WHERE abs(share - w) > 0.15""",
)
def _(spark, sf):
    items = all_items(spark, sf)
    return validation.balance_issues(validation.category_balance(items), items.agg(F.count(F.lit(1))).scalar())


@query(
    "validate_coverage",
    f"""WITH {_ITEMS} SELECT CAST(count(*) AS BIGINT) AS total_items,
      round(count(DISTINCT source_location) / least((SELECT count(*) FROM part), count(*) * 2), 6) AS coverage_score,
      CAST(count(*) FILTER (confidence = 'low') AS BIGINT) AS low_confidence,
      count(*) FILTER (confidence = 'low') > count(*) * 0.2 AS low_issue FROM items""",
)
def _(spark, sf):
    items = all_items(spark, sf)
    total = table(spark, sf, "part").agg(F.count(F.lit(1))).scalar()
    result = validation.summarize(items, None, total)
    low = F.exists("issues", lambda i: F.contains(i, F.lit("low grounding confidence")))
    return result.select(
        "total_items", F.round("coverage_score", 6).alias("coverage_score"), "low_confidence", low.alias("low_issue")
    )


# Prompts are short: all their long parts are looked up among the prompts.
_VALID = f"""WITH {_ITEMS},
    texts AS (SELECT min(ord) AS ord, norm, length(norm) AS n FROM (SELECT ord, {_NORM.replace('text', 'prompt')} AS norm FROM items) GROUP BY norm),
    parts AS (SELECT DISTINCT ord, n, substring(norm, i, k) AS part FROM texts, unnest(range(n * 4 // 5 + 1, n)) AS u(k), unnest(range(1, n - k + 2)) AS v(i)),
    pairs AS (SELECT s.ord AS short_ord, p.ord AS long_ord FROM parts p JOIN texts s ON s.norm = p.part AND s.norm <> ''),
    {_FOLD},
    kept AS (SELECT * FROM items WHERE ord IN (SELECT ord FROM texts) AND ord NOT IN (SELECT ord FROM dropped)),
    counts AS (SELECT count(*) AS total_items, (SELECT count(*) FROM items) - count(*) AS removed,
      coalesce(count(DISTINCT source_location) / nullif(least((SELECT count(*) FROM part), count(*) * 2), 0), 0) AS coverage,
      count(*) FILTER (confidence = 'low') AS low FROM kept),
    uneven AS (SELECT count(*) AS k FROM (VALUES {WEIGHTS}) AS t(i, c, w)
      WHERE abs((SELECT count(*) FROM kept WHERE category = c) / (SELECT greatest(total_items, 1) FROM counts) - w) > 0.15)
    SELECT (removed = 0 AND k = 0 AND coverage >= 0.3 AND low <= total_items * 0.2) OR (removed = 0 AND coverage >= 0.2) AS passed,
      CAST(total_items AS BIGINT) AS total_items, CAST(removed AS BIGINT) AS duplicates_removed, round(coverage, 9) AS coverage_score,
      CAST(low AS BIGINT) AS low_confidence FROM counts, uneven"""


@query("validate_eval_set", _VALID)
def _(spark, sf):
    # Part prompts share most of their text, so the greedy pass has work.
    result = validation.validate_items(all_items(spark, sf), table(spark, sf, "part").count()).result
    return result.withColumn("coverage_score", F.round("coverage_score", 9))


@query(
    "validate_confidence_tally",
    f"""WITH {_ITEMS} SELECT confidence AS grounding_confidence, CAST(count(*) AS BIGINT) AS "items" FROM items GROUP BY confidence""",
)
def _(spark, sf):
    return validation.confidence_tally(all_items(spark, sf)).select("grounding_confidence", "items")


# --- diagnostics -----------------------------------------------------------------------------------

_CONTENT = "('P_BRAND'), ('p_name'), ('other')"
CONTENT_FIELDS = ["P_BRAND", "p_name", "other"]


@query(
    "diagnose_field_coverage",
    f"""SELECT field, field IN (SELECT lower(x) FROM (VALUES {_CONTENT}) AS t(x)) AS indexed FROM ({q.profile('part', q.PART)})""",
)
def _(spark, sf):
    return diagnostics.field_coverage(profiling.profile_columns(table(spark, sf, "part")), CONTENT_FIELDS)


@query(
    "diagnose_coverage_summary",
    f"""SELECT CAST(count(*) FILTER (i) AS BIGINT) AS indexed_fields, CAST(count(*) FILTER (NOT i) AS BIGINT) AS unindexed_fields,
      CAST(round(100 * count(*) FILTER (i) / count(*)) AS BIGINT) AS coverage_percent FROM (
      SELECT field IN ('p_brand', 'p_name') AS i FROM ({q.profile('part', q.PART)}))""",
)
def _(spark, sf):
    columns = profiling.profile_columns(table(spark, sf, "part"))
    return diagnostics.coverage_summary(diagnostics.field_coverage(columns, CONTENT_FIELDS))


_WORDING = r"""regexp_matches(prompt, '(?i)\b(how many|count|total|average|sum|all)\b')"""
_BROAD = r"""regexp_matches(prompt, '(?i)\b(list all|show all|every|summarize all|everything)\b')"""
_ASKED = "SELECT conv_id * 4294967296 + turn AS ord, CASE WHEN conv_id % 4 = 0 THEN 'List all of: ' || text ELSE text END AS prompt FROM conversations"


@query("diagnose_wording", f"SELECT ord, {_WORDING} AS aggregation, {_BROAD} AS broad FROM ({_ASKED})")
def _(spark, sf):
    asked = table(spark, sf, "conversations").selectExpr(
        "conv_id * 4294967296 + turn AS ord", "if(conv_id % 4 = 0, concat('List all of: ', text), text) AS prompt"
    )
    return asked.select(
        "ord",
        diagnostics.aggregation_wording(F.col("prompt")).alias("aggregation"),
        diagnostics.broad_wording(F.col("prompt")).alias("broad"),
    )


def diagnosed(spark, sf):
    columns = profiling.column_dimension(table(spark, sf, "part"))
    coverage = diagnostics.field_coverage(columns, CONTENT_FIELDS)
    # Wordings vary by item: some prompts ask for everything or for totals.
    items = all_items(spark, sf).withColumn(
        "prompt",
        F.expr("CASE WHEN ord % 5 = 0 THEN concat('Show all: ', prompt) WHEN ord % 7 = 0 THEN concat('Total? ', prompt) ELSE prompt END"),
    )
    return diagnostics.diagnose_items(items, coverage)


_ISSUES = f"""{_ITEMS.replace('items AS', 'plain AS', 1)},
  items AS (SELECT * REPLACE (CASE WHEN ord % 5 = 0 THEN 'Show all: ' || prompt WHEN ord % 7 = 0 THEN 'Total? ' || prompt ELSE prompt END AS prompt) FROM plain),
  fields AS (SELECT ord, prompt, unnest(facts) AS f, generate_subscripts(facts, 1) AS i FROM items),
  iss AS (SELECT ord, prompt, i, 'References unindexed field "' || split_part(f, '=', 1) || '" — the assistant may not find this data' AS issue, true AS unindexed
      FROM fields WHERE split_part(f, '=', 1) IN ('p_partkey', 'p_type', 'p_size', 'p_retailprice')
    UNION ALL SELECT ord, prompt, 100, 'Aggregation question without summary items — the assistant may give unreliable results', false FROM items WHERE {_WORDING}
    UNION ALL SELECT ord, prompt, 101, 'Broad/exhaustive question — connector retrieval returns limited results', false FROM items WHERE {_BROAD}),
  num AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY i) - 1 AS pos FROM iss),
  sev AS (SELECT items.ord, items.prompt, CASE WHEN count(issue) = 0 THEN 'ok' WHEN bool_or(unindexed) THEN 'error' ELSE 'warning' END AS severity,
      coalesce(bool_or(unindexed), false) AS unindexed, coalesce(bool_or(i = 100), false) AS agg
    FROM items LEFT JOIN iss ON iss.ord = items.ord GROUP BY items.ord, items.prompt)"""


@query("diagnose_item_issues", f"WITH {_ISSUES} SELECT ord, CAST(pos AS INTEGER) AS pos, issue FROM num")
def _(spark, sf):
    return diagnostics.issue_rows(diagnosed(spark, sf), ["ord"])


@query("diagnose_severity", f"WITH {_ISSUES} SELECT ord, severity FROM sev")
def _(spark, sf):
    return diagnosed(spark, sf).select("ord", "severity")


@query(
    "diagnose_summary",
    f"""WITH {_ISSUES} SELECT CAST(count(*) AS BIGINT) AS total_items, CAST(count(*) FILTER (severity = 'ok') AS BIGINT) AS ok_items,
      CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS warning_items, CAST(count(*) FILTER (severity = 'error') AS BIGINT) AS error_items,
      CAST(count(*) FILTER (unindexed) AS BIGINT) AS targeting_unindexed, CAST(count(*) FILTER (agg) AS BIGINT) AS aggregation_warnings FROM sev""",
)
def _(spark, sf):
    return diagnostics.diagnostic_summary(diagnosed(spark, sf))


@query("diagnose_aggregation_prompts", f"WITH {_ISSUES} SELECT ord, prompt FROM sev WHERE agg")
def _(spark, sf):
    return diagnostics.aggregation_prompts(diagnosed(spark, sf))


@query("diagnose_warnings", f"WITH {_ISSUES} SELECT ord, CAST(pos AS INTEGER) AS pos, prompt || ': ' || issue AS warning FROM num")
def _(spark, sf):
    return diagnostics.warning_lines(diagnosed(spark, sf))


@query(
    "diagnose_shown_warnings",
    f"""WITH {_ISSUES} SELECT row_number() OVER (ORDER BY ord, pos) AS warning_no, prompt || ': ' || issue AS warning,
      CAST((SELECT count(*) FROM num) - 5 AS BIGINT) AS more FROM num ORDER BY ord, pos LIMIT 5""",
)
def _(spark, sf):
    return diagnostics.shown_warnings(diagnostics.warning_lines(diagnosed(spark, sf)))
