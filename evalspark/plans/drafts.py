"""Question drafts over the given tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.operators import questions
from evalspark.plans import sqltext as q
from evalspark.plans.registry import numbered, scan_table, table

SHIFT = 1 << questions.CATEGORY_SHIFT
KINDS = {name: kind for columns in (q.PART, q.CUSTOMER, q.SUPPLIER, q.ORDERS) for name, kind in columns}
KINDS["n_name"] = KINDS["r_name"] = "str"


def _rows(spark, sf, name) -> DataFrame:
    """The numbered table on all cores: a table of millions of short rows can be one split of a file, and each row makes several questions."""
    rows, cores = numbered(spark, sf, name), spark.sparkContext.defaultParallelism
    if scan_table(spark, sf, name).rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores, "row_index")


def part(spark, sf) -> questions.Dataset:
    return questions.Dataset(_rows(spark, sf, "part"), "part.parquet", "p_name", "p_partkey")


def supplier(spark, sf) -> questions.Dataset:
    return questions.Dataset(_rows(spark, sf, "supplier"), "supplier.parquet", "s_name")


def customer(spark, sf) -> questions.Dataset:
    return questions.Dataset(_rows(spark, sf, "customer"), "customer.parquet", "c_name")


def orders(spark, sf) -> questions.Dataset:
    return questions.Dataset(_rows(spark, sf, "orders"), "orders.parquet", "o_orderpriority", "o_orderkey")


def customer_places(spark, sf) -> questions.Dataset:
    """Customers with nation and region names; nation has 25 rows and region 5."""
    places = table(spark, sf, "nation").join(
        F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = numbered(spark, sf, "customer").join(
        F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return questions.Dataset(rows.select("row_index", "c_name", "n_name", "r_name"), "customer.parquet", "c_name")


PLACES_SQL = """(SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""


class Sql:
    """SQL text of the drafts of one table whose integer key equals the row index."""

    def __init__(self, source: str, label: str, index: str, title: str, key: str | None = None):
        self.source, self.label, self.index, self.title, self.key = source, label, index, title, key

    def text(self, column: str) -> str:
        return q.text_of(column, KINDS[column])

    def entity(self) -> str:
        if self.key is None:
            return self.text(self.title)
        return f"{self.text(self.title)} || ' ({self.key} ' || {self.text(self.key)} || ')'"

    def location(self, index: str | None = None) -> str:
        return f"'{self.label}:row ' || CAST({index or self.index} + 1 AS VARCHAR)"

    @staticmethod
    def draft(category: str, order: str, prompt: str, answer: str, facts: str, location: str, source: str) -> str:
        base = list(questions.CATEGORY_WEIGHTS).index(category) * SHIFT
        return f"""SELECT CAST({base} + {order} AS BIGINT) AS ord, {prompt} AS prompt, '{category}' AS category,
          '{questions.DIFFICULTY[category]}' AS difficulty, {answer} AS expected_answer, {facts} AS facts,
          {location} AS source_location FROM {source}"""

    def single(self, fields) -> str:
        stated = " || ', ' || ".join(f"'{f} is ' || {self.text(f)}" for f in fields)
        facts = "[" + ", ".join(f"'{f}=' || {self.text(f)}" for f in fields) + "]"
        return self.draft(
            "single_record_lookup", self.index, f"'What do we know about ' || {self.entity()} || '?'",
            f"{self.entity()} || ': ' || {stated} || '.'", facts, self.location(), self.source,
        )

    def attribute(self, fields) -> str:
        return " UNION ALL ".join(
            self.draft(
                "attribute_retrieval", f"{self.index} * {len(fields)} + {i}",
                f"'What is the {f} of ' || {self.entity()} || '?'",
                f"'The {f} of ' || {self.entity()} || ' is ' || {self.text(f)} || '.'",
                f"['{f}=' || {self.text(f)}]", self.location(), self.source,
            )
            for i, f in enumerate(fields)
        )

    def filtered(self, fields, listed=10) -> str:
        parts = []
        for i, f in enumerate(fields):
            source = f"""(SELECT v, count(*) AS n, min(idx) AS first_row,
                string_agg(e, '; ' ORDER BY e, idx) FILTER (r <= {listed}) AS names FROM (
                  SELECT {self.text(f)} AS v, {self.entity()} AS e, {self.index} AS idx,
                    row_number() OVER (PARTITION BY {f} ORDER BY {self.entity()}, {self.index}) AS r FROM {self.source}) GROUP BY v)"""
            parts.append(
                self.draft(
                    "filtered_find", f"first_row * {len(fields)} + {i}", f"'Which records have {f} ' || v || '?'",
                    f"'With {f} ' || v || ': ' || names || CASE WHEN n > {listed} THEN ' and ' || CAST(n - {listed} AS VARCHAR) || ' more' ELSE '' END || '.'",
                    f"['{f}=' || v]", self.location("first_row"), source,
                )
            )
        return " UNION ALL ".join(parts)

    def temporal(self, column) -> str:
        source = f"""(SELECT *, year({column}) AS y FROM (
            SELECT *, 0 AS pos, 'earliest' AS role, row_number() OVER (PARTITION BY year({column}) ORDER BY {column}, {self.index}) AS r FROM {self.source}
            UNION ALL
            SELECT *, 1, 'latest', row_number() OVER (PARTITION BY year({column}) ORDER BY {column} DESC, {self.index}) FROM {self.source}) WHERE r = 1)"""
        tail = f"role || ' {column} in ' || CAST(y AS VARCHAR)"
        return self.draft(
            "temporal", "y * 2 + pos", f"'Which record has the ' || {tail} || '?'",
            f"{self.entity()} || ' has the ' || {tail} || ': ' || {self.text(column)} || '.'",
            f"['{column}=' || {self.text(column)}, '{self.title}=' || {self.text(self.title)}]", self.location(), source,
        )

    def comparison(self, group, number) -> str:
        source = f"""(SELECT * FROM (SELECT {self.index} AS idx, {self.entity()} AS a, {number} AS x, {self.text(number)} AS xt,
            lead({self.entity()}) OVER w AS b, lead({number}) OVER w AS y, lead({self.text(number)}) OVER w AS yt
            FROM {self.source} WINDOW w AS (PARTITION BY {group} ORDER BY {self.index})) WHERE b IS NOT NULL)"""
        a, b = "a || ' (' || xt || ')'", "b || ' (' || yt || ')'"
        return self.draft(
            "comparison", "idx", f"'Which has the higher {number}: ' || a || ' or ' || b || '?'",
            f"CASE WHEN x > y THEN {a} || ' has a higher {number} than ' || {b} WHEN x < y THEN {b} || ' has a higher {number} than ' || {a} ELSE {a} || ' and ' || {b} || ' have the same {number}' END || '.'",
            f"['{number}=' || xt, '{number}=' || yt]", self.location("idx"), source,
        )

    def edge(self, first, second) -> str:
        source = f"""(SELECT a, min(ia) AS ia, arg_min(b, ib) AS b FROM
            (SELECT a, dense_rank() OVER (ORDER BY a) - 1 AS ia FROM (SELECT DISTINCT {first} AS a FROM {self.source})),
            (SELECT b, dense_rank() OVER (ORDER BY b) - 1 AS ib FROM (SELECT DISTINCT {second} AS b FROM {self.source}))
            WHERE (a, b) NOT IN (SELECT ({first}, {second}) FROM {self.source}) GROUP BY a)"""
        return self.draft(
            "edge_case", "ia", f"'Which records have {first} ' || a || ' and {second} ' || b || '?'",
            f"'There are no matching records: none has {first} ' || a || ' and {second} ' || b || '.'",
            f"['{first}=' || a, '{second}=' || b]", f"'{self.label}'", source,
        )


PART = Sql("part", "part.parquet", "p_partkey", "p_name", "p_partkey")
SUPPLIER = Sql("supplier", "supplier.parquet", "s_suppkey", "s_name")
CUSTOMER = Sql("customer", "customer.parquet", "c_custkey", "c_name")
ORDERS = Sql("orders", "orders.parquet", "o_orderkey", "o_orderpriority", "o_orderkey")
PLACES = Sql(PLACES_SQL, "customer.parquet", "c_custkey", "c_name")

PART_FIELDS = ["p_brand", "p_type", "p_size", "p_retailprice"]
DRAFT_COLUMNS = "ord, prompt, category, difficulty, expected_answer, array_to_string(facts, ' | ') AS facts, source_location"

# One eval set over whole tables: every category over every row it applies to.
ALL_SQL = " UNION ALL ".join(
    [
        PART.single(PART_FIELDS[:3]),
        PART.attribute(PART_FIELDS),
        CUSTOMER.filtered(["c_mktsegment"]),
        ORDERS.temporal("o_orderdate"),
        PART.comparison("p_type", "p_retailprice"),
        PLACES.edge("r_name", "n_name"),
    ]
)


def all_drafts(spark, sf) -> DataFrame:
    parts = part(spark, sf)
    return questions.union_drafts(
        questions.single_record_questions(parts, PART_FIELDS[:3]),
        questions.attribute_questions(parts, PART_FIELDS),
        questions.filtered_find_questions(customer(spark, sf), ["c_mktsegment"]),
        questions.temporal_questions(orders(spark, sf), "o_orderdate"),
        questions.comparison_questions(parts, "p_type", "p_retailprice"),
        questions.edge_case_questions(customer_places(spark, sf), "r_name", "n_name"),
    )


def flat(drafts: DataFrame) -> DataFrame:
    """Drafts with the facts as one text, for comparison with SQL."""
    return drafts.select(
        "ord", "prompt", "category", "difficulty", "expected_answer",
        F.array_join("supporting_facts", " | ").alias("facts"), "source_location",
    )
