"""Question drafts with exact answers: quotas, fact context and one generator per category.

All generators return ``ord, prompt, category, difficulty, expected_answer, supporting_facts,
source_location`` and run over every row; :func:`apply_quotas` then keeps the first of each category.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import js_string, trim_ws
from evalspark.operators.profiling import ROW_INDEX
from evalspark.sources.rowindex import with_row_index_by

# Question categories with their target shares, in order.
CATEGORY_WEIGHTS = {
    "single_record_lookup": 0.30,
    "attribute_retrieval": 0.20,
    "filtered_find": 0.20,
    "temporal": 0.10,
    "comparison": 0.10,
    "edge_case": 0.10,
}
DIFFICULTY = {
    "single_record_lookup": "easy",
    "attribute_retrieval": "easy",
    "filtered_find": "medium",
    "temporal": "medium",
    "comparison": "hard",
    "edge_case": "hard",
}
DEFAULT_COUNT, MIN_COUNT, MAX_COUNT = 30, 10, 50
LISTED_ENTITIES = 10
FACTS_PER_FIELD = 5
# Room for 2**58 drafts per category below the category's position.
CATEGORY_SHIFT = 58


def clamp_count(count: int) -> int:
    """The question count accepted on an interactive run."""
    return max(MIN_COUNT, min(MAX_COUNT, count))


def category_dimension(spark: SparkSession) -> DataFrame:
    """Six rows ``(category_pos, category, weight)``."""
    values = ", ".join(f"({i}, '{c}', {w}D)" for i, (c, w) in enumerate(CATEGORY_WEIGHTS.items()))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(category_pos, category, weight)")


def category_quotas(spark: SparkSession, count: int = DEFAULT_COUNT) -> DataFrame:
    quota = F.greatest(F.lit(1), F.floor(F.lit(count) * F.col("weight") + 0.5)).cast("bigint")
    return category_dimension(spark).select("category_pos", "category", quota.alias("quota"))


def apply_quotas(drafts: DataFrame, count: int = DEFAULT_COUNT, block_rows: int = 1_000_000) -> DataFrame:
    """The first ``quota`` drafts of each category by ``ord``.

    Drafts are ranked inside (category, block of ``ord``) first, and only the first ones of each block are ranked again,
    so a category with most of the drafts never reaches one task as a whole, whatever the count is.
    """
    highest = max(max(1, int(count * w + 0.5)) for w in CATEGORY_WEIGHTS.values())
    rank = F.row_number().over(Window.partitionBy("category").orderBy("ord"))
    block = F.floor(F.col("ord") / block_rows)
    in_block = F.row_number().over(Window.partitionBy("category", "_block").orderBy("ord"))
    firsts = drafts.withColumn("_block", block).withColumn("_rank", in_block).filter(F.col("_rank") <= highest)
    top = firsts.withColumn("_rank", rank).filter(F.col("_rank") <= highest)
    quotas = F.broadcast(category_quotas(drafts.sparkSession, count).select("category", "quota"))
    return top.join(quotas, "category").filter(F.col("_rank") <= F.col("quota")).select(*drafts.columns)


def describe_schema(profile: DataFrame, categories: DataFrame) -> DataFrame:
    """One line per column: ``name (type, u unique, n nulls, categories: first five)``."""
    first_seen = F.slice(
        F.transform(F.array_sort(F.collect_list(F.struct("first_idx", "value"))), lambda s: s["value"]), 1, 5
    )
    # At most 20 values per column are collected here.
    shown = categories.groupBy("field").agg(F.array_join(first_seen, ", ").alias("shown"))
    line = F.concat(
        F.col("field"),
        F.lit(" ("),
        F.col("data_type"),
        F.lit(", "),
        F.col("unique_count").cast("string"),
        F.lit(" unique, "),
        F.col("null_count").cast("string"),
        F.lit(" nulls"),
        F.coalesce(F.concat(F.lit(", categories: "), F.col("shown")), F.lit("")),
        F.lit(")"),
    )
    return profile.join(F.broadcast(shown), "field", "left").select("ord", line.alias("line"))


def intent_context(intents: DataFrame, facts: DataFrame, per_field: int = FACTS_PER_FIELD) -> DataFrame:
    """``(intent, pos, fact_no)``: the facts each intent may use.

    ``intents`` has ``intent, target_row_references, target_fields``. Facts are matched by exact row
    reference, in the order of the references; an intent without any match falls back to the first
    ``per_field`` facts of each of its fields.
    """
    refs = intents.select("intent", F.posexplode("target_row_references").alias("target", "row_ref"))
    by_row = refs.join(facts.select("row_ref", "fact_no"), "row_ref").select("intent", "target", "fact_no")
    unmatched = intents.join(by_row.select("intent").distinct(), "intent", "left_anti")
    first = Window.partitionBy("field").orderBy("fact_no")
    leading = (
        facts.select("field", "fact_no")
        .withColumn("n", F.row_number().over(first))
        .filter(F.col("n") <= per_field)
        .drop("n")
    )
    fields = unmatched.select("intent", F.posexplode("target_fields").alias("target", "field"))
    by_field = fields.join(leading, "field").select("intent", "target", "fact_no")
    return by_row.unionAll(by_field).select("intent", F.col("target").alias("pos"), "fact_no")


def attach_context(drafts: DataFrame, context: DataFrame) -> DataFrame:
    """Give the i-th draft the facts of the i-th intent, as ``referenced_facts``; at most as many as the intent has.

    ``drafts`` has ``draft`` (0-based position) and ``context`` the intents' ``intent`` position.
    """
    lists = context.groupBy("intent").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact_no"))), lambda s: s["fact_no"]).alias(
            "referenced_facts"
        )
    )
    return drafts.join(lists, drafts["draft"] == lists["intent"], "left").drop("intent")


@dataclass(frozen=True)
class Dataset:
    """A numbered table with the columns that name its entities."""

    rows: DataFrame
    label: str
    title: str
    key: str | None = None

    def text(self, column: str) -> Column:
        return js_string(F.col(f"`{column}`"), self.rows.schema[column].dataType)

    def entity(self) -> Column:
        title = self.text(self.title)
        if self.key is None:
            return title
        return F.concat(title, F.lit(f" ({self.key} "), self.text(self.key), F.lit(")"))

    def location(self, row_index: Column | None = None) -> Column:
        position = F.col(ROW_INDEX) if row_index is None else row_index
        return F.concat(F.lit(f"{self.label}:row "), (position + 1).cast("string"))

    def fact(self, column: str) -> Column:
        return F.concat(F.lit(f"{column}="), self.text(column))


def _drafts(df: DataFrame, category: str, order: Column) -> DataFrame:
    base = list(CATEGORY_WEIGHTS).index(category) << CATEGORY_SHIFT
    return df.select(
        (F.lit(base) + order.cast("bigint")).alias("ord"),
        "prompt",
        F.lit(category).alias("category"),
        F.lit(DIFFICULTY[category]).alias("difficulty"),
        "expected_answer",
        "supporting_facts",
        "source_location",
    )


def _filled(column: Column) -> Column:
    return column.isNotNull() & (column != "")


def single_record_questions(data: Dataset, fields: Sequence[str]) -> DataFrame:
    """What is known about one entity: its first fields with their values."""
    cells = [F.when(_filled(data.text(f)), F.struct(F.lit(f).alias("f"), data.text(f).alias("v"))) for f in fields]
    known = data.rows.filter(_filled(data.text(data.title))).withColumn("_cells", F.array_compact(F.array(*cells)))
    stated = F.array_join(F.transform("_cells", lambda c: F.concat(c["f"], F.lit(" is "), c["v"])), ", ")
    drafted = known.filter(F.size("_cells") > 0).select(
        ROW_INDEX,
        F.concat(F.lit("What do we know about "), data.entity(), F.lit("?")).alias("prompt"),
        F.concat(data.entity(), F.lit(": "), stated, F.lit(".")).alias("expected_answer"),
        F.transform("_cells", lambda c: F.concat(c["f"], F.lit("="), c["v"])).alias("supporting_facts"),
        data.location().alias("source_location"),
    )
    return _drafts(drafted, "single_record_lookup", F.col(ROW_INDEX))


def attribute_questions(data: Dataset, fields: Sequence[str]) -> DataFrame:
    """One attribute of one entity."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), data.text(f).alias("value")) for f in fields])
    melted = data.rows.filter(_filled(data.text(data.title))).select(
        ROW_INDEX, data.entity().alias("entity"), data.location().alias("source_location"),
        F.posexplode(cells).alias("pos", "cell"),
    )
    drafted = melted.filter(_filled(F.col("cell.value"))).select(
        ROW_INDEX,
        "pos",
        F.concat(F.lit("What is the "), "cell.field", F.lit(" of "), "entity", F.lit("?")).alias("prompt"),
        F.concat(F.lit("The "), "cell.field", F.lit(" of "), "entity", F.lit(" is "), "cell.value", F.lit(".")).alias(
            "expected_answer"
        ),
        F.array(F.concat("cell.field", F.lit("="), "cell.value")).alias("supporting_facts"),
        "source_location",
    )
    return _drafts(drafted, "attribute_retrieval", F.col(ROW_INDEX) * len(fields) + F.col("pos"))


def filtered_find_members(data: Dataset, fields: Sequence[str]) -> DataFrame:
    """``(field, value, rank, entity, row_index)``: every entity of every category value, in alphabetical order.

    The cells are sorted over all tasks at once and numbered; a rank is the distance to the value's first number, so a
    value that holds most rows is neither gathered nor sorted by itself.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field"), data.text(f).alias("value")) for f in fields])
    melted = data.rows.filter(_filled(data.text(data.title))).select(
        ROW_INDEX, data.entity().alias("entity"), F.explode(cells).alias("cell")
    )
    melted = melted.filter(_filled(F.col("cell.value"))).select("cell.*", "entity", ROW_INDEX)
    numbered = with_row_index_by(melted, ["field", "value", "entity", ROW_INDEX], "_n")
    starts = numbered.groupBy("field", "value").agg(F.min("_n").alias("_first"))
    return numbered.join(starts, ["field", "value"]).select(
        "field", "value", (F.col("_n") - F.col("_first") + 1).alias("rank"), "entity", ROW_INDEX
    )


def filtered_find_questions(data: Dataset, fields: Sequence[str], listed: int = LISTED_ENTITIES) -> DataFrame:
    """Which entities have a category value: a short text of the alphabetically first ones and how many more there are.

    ``filtered_find_members`` has the whole answer as rows.

    The list is a top-k per value and the rank filter is a constant, so map tasks send at most ``listed``
    entities per value; a value holding a third of the rows is counted, never gathered.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field"), data.text(f).alias("value")) for i, f in enumerate(fields)])
    melted = data.rows.filter(_filled(data.text(data.title))).select(
        ROW_INDEX, data.entity().alias("entity"), F.explode(cells).alias("cell")
    )
    melted = melted.filter(_filled(F.col("cell.value"))).select(ROW_INDEX, "entity", "cell.*")
    totals = melted.groupBy("pos", "field", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min(ROW_INDEX).alias("first_row")
    )
    order = Window.partitionBy("field", "value").orderBy("entity", ROW_INDEX)
    top = melted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= listed)
    names = top.groupBy("field", "value").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda s: s["entity"]), "; "
        ).alias("names")
    )
    more = F.when(F.col("n") > listed, F.concat(F.lit(" and "), (F.col("n") - listed).cast("string"), F.lit(" more")))
    drafted = totals.join(names, ["field", "value"]).select(
        "first_row",
        "pos",
        F.concat(F.lit("Which records have "), "field", F.lit(" "), "value", F.lit("?")).alias("prompt"),
        F.concat(
            F.lit("With "), "field", F.lit(" "), "value", F.lit(": "), "names", F.coalesce(more, F.lit("")), F.lit(".")
        ).alias("expected_answer"),
        F.array(F.concat("field", F.lit("="), "value")).alias("supporting_facts"),
        data.location(F.col("first_row")).alias("source_location"),
    )
    return _drafts(drafted, "filtered_find", F.col("first_row") * len(fields) + F.col("pos"))


def temporal_questions(data: Dataset, column: str) -> DataFrame:
    """Earliest and latest entity of each year by a date column.

    Extremes are found by hash aggregation of plain values (at most 9,999 years), then only the rows on
    an extreme date are looked at again; ties go to the first row.
    """
    dated = data.rows.filter(F.col(column).isNotNull()).select(
        ROW_INDEX, F.col(column).cast("timestamp").alias("t"), F.year(column).alias("year")
    )
    edges = dated.groupBy("year").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    on_edge = dated.join(F.broadcast(edges), "year")
    chosen = on_edge.groupBy("year").agg(
        F.min(F.when(F.col("t") == F.col("lo"), F.col(ROW_INDEX))).alias("earliest"),
        F.min(F.when(F.col("t") == F.col("hi"), F.col(ROW_INDEX))).alias("latest"),
    )
    picked = chosen.select(
        "year",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("pos"), F.lit("earliest").alias("role"), F.col("earliest").alias(ROW_INDEX)),
                F.struct(F.lit(1).alias("pos"), F.lit("latest").alias("role"), F.col("latest").alias(ROW_INDEX)),
            )
        ).alias("p"),
    ).select("year", "p.*")
    # Two rows per year at most, so the table is filtered by a broadcast.
    found = data.rows.join(F.broadcast(picked), ROW_INDEX)
    year = F.col("year").cast("string")
    drafted = found.select(
        "year",
        "pos",
        F.concat(F.lit("Which record has the "), "role", F.lit(f" {column} in "), year, F.lit("?")).alias("prompt"),
        F.concat(data.entity(), F.lit(f" has the "), "role", F.lit(f" {column} in "), year, F.lit(": "), data.text(column), F.lit(".")).alias(
            "expected_answer"
        ),
        F.array(data.fact(column), data.fact(data.title)).alias("supporting_facts"),
        data.location().alias("source_location"),
    )
    return _drafts(drafted, "temporal", F.col("year") * 2 + F.col("pos"))


def next_in_group(df: DataFrame, group: str, payload: Sequence[str], block_rows: int = 1_000_000) -> DataFrame:
    """Each row with ``next``, the payload of the following row (by ``row_index``) of its group.

    A window over a whole group would put a dominant group into one task. Rows are therefore paired
    inside (group, block of row indexes), and the small table of first and last rows per block links one
    block to the next.
    """
    columns = [ROW_INDEX, *payload]
    blocked = df.withColumn("_block", F.floor(F.col(ROW_INDEX) / block_rows))
    inner = Window.partitionBy(group, "_block").orderBy(ROW_INDEX)
    paired = blocked.withColumn("next", F.lead(F.struct(*columns)).over(inner))
    inside = paired.filter(F.col("next").isNotNull()).select(group, *columns, "next")
    ends = blocked.groupBy(group, "_block").agg(F.min(ROW_INDEX).alias("first"), F.max(ROW_INDEX).alias("last"))
    over_blocks = Window.partitionBy(group).orderBy("_block")
    links = ends.withColumn("following", F.lead("first").over(over_blocks)).filter(F.col("following").isNotNull())
    left = links.select(F.col("last").alias(ROW_INDEX), F.col("following").alias("_following"))
    right = df.select(F.struct(*columns).alias("next"), F.col(ROW_INDEX).alias("_following"))
    across = df.select(group, *columns).join(left, ROW_INDEX).join(right, "_following").select(group, *columns, "next")
    return inside.unionAll(across)


def comparison_questions(data: Dataset, group: str, number: str, block_rows: int = 1_000_000) -> DataFrame:
    """Which of two neighbouring entities of a group has the higher value."""
    usable = data.rows.filter(_filled(data.text(data.title)) & F.col(number).isNotNull() & _filled(data.text(group)))
    prepared = usable.select(
        ROW_INDEX,
        data.text(group).alias("group"),
        data.entity().alias("entity"),
        F.col(number).alias("num"),
        data.text(number).alias("shown"),
    )
    pairs = next_in_group(prepared, "group", ["entity", "num", "shown"], block_rows)
    mine, other = F.col("num"), F.col("next.num")
    name_a, name_b = F.col("entity"), F.col("next.entity")
    with_a = F.concat(name_a, F.lit(" ("), "shown", F.lit(")"))
    with_b = F.concat(name_b, F.lit(" ("), "next.shown", F.lit(")"))
    answer = (
        F.when(mine > other, F.concat(with_a, F.lit(f" has a higher {number} than "), with_b))
        .when(mine < other, F.concat(with_b, F.lit(f" has a higher {number} than "), with_a))
        .otherwise(F.concat(with_a, F.lit(" and "), with_b, F.lit(f" have the same {number}")))
    )
    drafted = pairs.select(
        ROW_INDEX,
        F.concat(F.lit(f"Which has the higher {number}: "), name_a, F.lit(" or "), name_b, F.lit("?")).alias("prompt"),
        F.concat(answer, F.lit(".")).alias("expected_answer"),
        F.array(F.concat(F.lit(f"{number}="), "shown"), F.concat(F.lit(f"{number}="), "next.shown")).alias(
            "supporting_facts"
        ),
        data.location().alias("source_location"),
    )
    return _drafts(drafted, "comparison", F.col(ROW_INDEX))


def edge_case_questions(data: Dataset, first: str, second: str) -> DataFrame:
    """For each value of ``first``, the lowest value of ``second`` that no row has together with it.

    Values of ``second`` are ranked. The lowest rank that a value lacks is 0 or follows one that it has, so the present
    pairs themselves give all candidates and the domains are never multiplied. A value that has every other gives none.
    """
    pairs = (
        data.rows.select(data.text(first).alias("a"), data.text(second).alias("b"))
        .filter(_filled(F.col("a")) & _filled(F.col("b")))
        .distinct()
    )
    ranks = with_row_index_by(pairs.select("b").distinct(), ["b"], "ib")
    order = with_row_index_by(pairs.select("a").distinct(), ["a"], "ia")
    present = pairs.join(ranks, "b").select("a", "ib")
    candidates = order.select("a", F.lit(0).cast("bigint").alias("ib")).union(present.select("a", F.col("ib") + 1))
    absent = candidates.join(present, ["a", "ib"], "left_anti").join(ranks, "ib")
    lowest = absent.groupBy("a").agg(F.min_by("b", "ib").alias("b"))
    drafted = lowest.join(order, "a").select(
        "ia",
        F.concat(F.lit(f"Which records have {first} "), "a", F.lit(f" and {second} "), "b", F.lit("?")).alias("prompt"),
        F.concat(
            F.lit(f"There are no matching records: none has {first} "), "a", F.lit(f" and {second} "), "b", F.lit(".")
        ).alias("expected_answer"),
        F.array(F.concat(F.lit(f"{first}="), "a"), F.concat(F.lit(f"{second}="), "b")).alias("supporting_facts"),
        F.lit(data.label).alias("source_location"),
    )
    return _drafts(drafted, "edge_case", F.col("ia"))


def union_drafts(*drafts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, drafts)


# --- replies of a model ----------------------------------------------------------------------------

REPLY_QUESTION = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("supporting_facts", T.ArrayType(T.StringType())),
        T.StructField("source_location", T.StringType()),
    ]
)
_FENCE = "(?is)```(?:json)?\\s*(.*?)```"


def reply_json(reply: Column) -> Column:
    """The JSON value of a reply as a variant: the whole text, else a fenced block, else ``{`` to ``}``.

    Null where a reply holds none. A fenced block or a brace span that is present but broken counts as
    no JSON, as later forms are tried only when the earlier ones are absent.
    """
    bare = trim_ws(F.regexp_replace(reply, "\u001b\\[[0-9;]*m", ""))
    fenced = trim_ws(F.regexp_extract(bare, _FENCE, 1))
    has_fence = bare.rlike(_FENCE) & (fenced != "")
    start = F.instr(bare, F.lit("{"))
    end = F.length(bare) - F.instr(F.reverse(bare), F.lit("}")) + 1
    has_span = (start > 0) & F.contains(bare, F.lit("}")) & (end > start)
    span = F.substring(bare, start, end - start + 1)
    return F.coalesce(
        F.try_parse_json(bare),
        F.when(has_fence, F.try_parse_json(fenced)).when(has_span, F.try_parse_json(span)),
    )


def explode_reply(replies: DataFrame, ids: Sequence[str], reply: str = "reply", key: str = "questions", schema: T.StructType = REPLY_QUESTION) -> DataFrame:
    """One row per element of ``key`` in each reply; replies without it give no rows."""
    parsed = replies.select(*ids, reply_json(F.col(reply)).alias("_json"))
    items = F.try_variant_get("_json", f"$.{key}", "array<variant>")
    exploded = parsed.select(*ids, F.posexplode(items).alias("pos", "_item"))
    fields = [
        F.try_variant_get("_item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields
    ]
    return exploded.select(*ids, "pos", *fields)
