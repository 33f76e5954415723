"""Validation of evaluation items: duplicates, category balance, coverage, confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.overlap import KEYS, SIDES, SPANS, key_rows, side_rows, span_rows
from evalspark.functions.text import normalize_prompt
from evalspark.operators.graphs import drop_linked_to_kept
from evalspark.operators.joins import lookup_join
from evalspark.operators.placed import beside, place
from evalspark.operators.questions import CATEGORY_WEIGHTS, category_dimension
from evalspark.session import ensure_checkpoint_dir, scratch_path

MAX_SHARE_GAP = 0.15
MIN_COVERAGE = 0.3
PASS_COVERAGE = 0.2
MAX_LOW_SHARE = 0.2
# Shapes (position of the block and length) of a block that are tried on each of its containers; beyond, sides are matched first.
MOST_SHAPES = 16


def first_of_equal(texts: DataFrame) -> DataFrame:
    """Of rows with equal ``norm`` keep the one with the lowest ``ord``.

    The rank filter keeps one row per text and map task before the shuffle, so copies that make up a
    large part of the table do not meet in one task; the digest keeps the sort keys short. Texts are made and moved once.
    """
    return _first_of(texts, F.col("norm"))


def _first_of(rows: DataFrame, norm: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(F.sha2(norm, 256)).orderBy("ord"))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def first_ords(texts: DataFrame) -> DataFrame:
    """``ord`` of the rows that ``first_of_equal`` keeps: only digests are grouped, and no text is moved."""
    return texts.groupBy(F.sha2("norm", 256)).agg(F.min("ord").alias("ord")).select("ord")


def _written(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once and compressed."""
    path = scratch_path(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)


def _span(shape: Column) -> Column:
    """Where a shape would lie in its container, and the hash it must have if all its texts share one."""
    return F.struct((F.col("pos") - shape.pos).alias("start"), shape["size"].alias("size"), F.when(shape.single, shape.whole).alias("whole"))


def _fits(span: Column, length: Column) -> Column:
    return (span.start >= 0) & (span.start + span["size"] <= length) & (span["size"] < length) & (span["size"] * 5 > length * 4)


def candidate_spans(texts: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """``(ord, start, size, digest)``: spans of a text that may be another whole text; none of those that are one is missing.

    ``texts`` has ``ord`` and ``norm``, or is placed already and ``chosen`` names its rows. Texts aren't moved: blocks, then
    sides, then spans are taken from them where they lie.

    1. each text gives one block key as the contained text and about ten as the container (``functions/overlap``);
       containers of a block in which no shorter text is contained go at once;
    2. a block of at most ``MOST_SHAPES`` shapes proposes each of them to its containers; the others are matched by sides
       (``_spans_by_sides``), so what is proposed doesn't grow with the pairs of texts that share a block;
    3. the proposed lengths are tried on the text, in one pass with the digest of those left.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    if chosen is None:
        texts = place(texts.select("ord", "norm"), "norms")
        chosen = texts
    # Read by every step below.
    keys = _written(beside(texts, chosen.select("row"), key_rows, KEYS), "block-keys").withColumn("_block", F.xxhash64("size_class", "block_key"))
    inside, around = keys.filter("contained"), keys.filter("NOT contained")
    shapes = inside.groupBy("_block", "pos", F.col("len").alias("size")).agg(
        F.min("whole").alias("whole"), (F.min("whole") == F.max("whole")).alias("single")
    )
    blocks = shapes.groupBy("_block").agg(F.min("size").alias("_least"), (F.count(F.lit(1)) > MOST_SHAPES).alias("_many")).checkpoint()
    few = lookup_join(shapes, blocks.filter("NOT _many"), "_block", "inner")
    few = few.select("_block", F.struct("pos", "size", "whole", "single").alias("shape"))
    met = around.join(few, "_block").select("row", "len", _span(F.col("shape")).alias("span"))
    spans = met.filter(_fits(F.col("span"), F.col("len"))).select("row", "span.*")
    many = blocks.filter("_many")
    if not many.isEmpty():
        wanted = lookup_join(around, many, "_block", "inner").filter(F.col("_least") < F.col("len"))
        sides = beside(texts, wanted.select("row", "size_class", "block_key", "pos"), side_rows, SIDES)
        spans = spans.unionAll(_spans_by_sides(_written(sides, "sides"), inside.join(many, "_block", "left_semi")))
    return beside(texts, spans, span_rows, SPANS)


def _spans_by_sides(around: DataFrame, inside: DataFrame) -> DataFrame:
    """``(row, start, size, whole)``: spans of containers that agree with a contained text on both sides of a block.

    The left sides of a container's block are looked up among the distinct left sides of contained texts, then its right sides
    among the distinct (left, right) sides. A side counts up to a multiple of its grain, so a container looks up a root of
    its length in sides, however many texts share the block.
    """
    inside = inside.select(
        F.xxhash64("size_class", "block_key", "left_at", "left_hash").alias("_left"),
        F.xxhash64("size_class", "block_key", "left_at", "left_hash", "right_at", "right_hash").alias("_sides"),
        "pos", F.col("len").alias("size"), "whole",
    )
    block = ["row", "size_class", "block_key", "pos"]
    lefts = around.select(*block, "left_first", F.posexplode("lefts").alias("_i", "_left_hash"))
    lefts = lefts.select(*block, (F.col("left_first") + F.col("_i")).alias("_left_at"), "_left_hash")
    lefts = lefts.withColumn("_left", F.xxhash64("size_class", "block_key", "_left_at", "_left_hash"))
    lefts = lookup_join(lefts, inside.select("_left").distinct(), "_left", "inner").drop("_left")
    # The right sides join the few left sides that are matched; they don't travel with all of them.
    sides = lefts.join(around.select(*block, "len", "right_first", "rights"), block)
    sides = sides.select("*", F.posexplode("rights").alias("_i", "_hash")).withColumn("_right_at", F.col("right_first") + F.col("_i"))
    sides = sides.select(
        "row", "pos", "len", F.xxhash64("size_class", "block_key", "_left_at", "_left_hash", "_right_at", "_hash").alias("_sides")
    )
    # A cell holds at most as many shapes as pairs of lengths within its grains; a shape of one text names its hash.
    shapes = inside.groupBy("_sides", "pos", "size").agg(F.min("whole").alias("whole"), (F.min("whole") == F.max("whole")).alias("single"))
    cells = shapes.groupBy("_sides").agg(F.collect_list(F.struct("pos", "size", "whole", "single")).alias("shapes"))
    found = lookup_join(sides, cells, "_sides", "inner")
    proposed = F.filter(F.transform("shapes", _span), lambda s: _fits(s, F.col("len")))
    return found.select("row", F.explode(proposed).alias("span")).select("row", "span.*")


def near_duplicate_pairs(texts: DataFrame) -> DataFrame:
    """``(short_ord, long_ord)``: distinct texts where the longer contains the shorter, ratio above 0.8.

    ``texts`` has ``ord`` and distinct ``norm``. The digests of candidate spans are looked up among the digests of all texts, of
    which every digest has exactly one.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    placed = _placed(texts)
    return _pairs(placed, placed.select("row", "ord", "digest"))


def _placed(texts: DataFrame) -> DataFrame:
    """``ord``, ``norm``, its ``digest`` and the ``row``, written where they are made."""
    return place(texts.select("ord", "norm").withColumn("digest", F.unhex(F.sha2("norm", 256))), "norms")


def _pairs(placed: DataFrame, chosen: DataFrame) -> DataFrame:
    pieces = candidate_spans(placed, chosen).select(F.col("ord").alias("long_ord"), "digest").distinct()
    digests = chosen.select("digest", F.col("ord").alias("short_ord"))
    return lookup_join(pieces, digests, "digest", "inner").select("short_ord", "long_ord").distinct()


def resolve_keep_first(pairs: DataFrame) -> DataFrame:
    """``ord`` of the items that a greedy pass in ``ord`` order drops: those matching an earlier kept item."""
    links = pairs.select(F.least(*pairs.columns).alias("earlier"), F.greatest(*pairs.columns).alias("later"))
    return drop_linked_to_kept(links.filter(F.col("earlier") < F.col("later")))


def deduplicate(items: DataFrame, text: str = "prompt") -> DataFrame:
    """Items that a greedy first-come pass keeps: no equal and no near-equal earlier kept item.

    Copies of a dropped text match the same kept item, so equal texts can go first. Of the items only the normalised texts
    are written; the items themselves are read again for the result, so those that are costly to make are checkpointed first.
    """
    ensure_checkpoint_dir(items.sparkSession)
    norm = normalize_prompt(F.col(text))
    placed = _placed(items.select("ord", norm.alias("norm")))
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("ord", "row"))
    ords = placed.select("row", "ord", "digest")
    first = _written(ords.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank"), "first")
    dropped = resolve_keep_first(_pairs(placed, first))
    if ords.groupBy("ord").count().filter("count > 1 OR ord IS NULL").isEmpty():
        # Each item is named by its ``ord``, so its text isn't needed again.
        kept = first.select("ord").join(dropped, "ord", "left_anti")
        return items.join(kept, "ord", "left_semi")
    return _first_of(items, norm).join(dropped, "ord", "left_anti")


def category_balance(items: DataFrame) -> DataFrame:
    """Counts of the six categories in order, zero where a category is missing."""
    counts = items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    # Counts are one row per category value; the dimension has six rows.
    return (
        category_dimension(items.sparkSession)
        .join(F.broadcast(counts.filter(F.col("category").isin(list(CATEGORY_WEIGHTS)))), "category", "left")
        .select("category_pos", "category", F.coalesce("n", F.lit(0).cast("bigint")).alias("items"), "weight")
    )


def _percent(share: Column) -> Column:
    return F.floor(share * 100 + 0.5).cast("bigint").cast("string")


def balance_issues(balance: DataFrame, total: Column) -> DataFrame:
    """Categories whose share is more than 15 points away from the target."""
    share = F.col("items") / F.greatest(total, F.lit(1))
    text = F.concat(
        F.lit('Category "'),
        "category",
        F.lit('" is '),
        F.when(share < F.col("weight"), "under").otherwise("over"),
        F.lit("-represented ("),
        _percent(share),
        F.lit("% vs "),
        _percent(F.col("weight")),
        F.lit("% target)"),
    )
    return balance.filter(F.abs(share - F.col("weight")) > MAX_SHARE_GAP).select("category_pos", text.alias("issue"))


def coverage_score(locations: Column, items: Column, total_rows: Column) -> Column:
    """Distinct locations over the most that could be referenced; 0 for an empty table."""
    return F.when(total_rows > 0, F.coalesce(F.try_divide(locations, F.least(total_rows, items * 2)), F.lit(0.0))).otherwise(0.0)


@dataclass
class Validation:
    """Kept items, the one-row result and the issues in order."""

    items: DataFrame
    result: DataFrame
    issues: DataFrame


def summarize(kept: DataFrame, item_count: Column | None, total_rows: Column) -> DataFrame:
    """One row with ``passed``, counts, coverage and the list of issues; one aggregation over the items.

    ``item_count`` is the number of items before duplicates went; None where all were kept.
    """
    per_category = [F.count_if(F.col("category") == c).alias(f"n_{c}") for c in CATEGORY_WEIGHTS]
    one = kept.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct("source_location").alias("locations"),
        F.count_if(F.col("grounding_confidence") == "low").alias("low_confidence"),
        *per_category,
    )
    before = F.col("total_items") if item_count is None else item_count
    one = one.withColumn("duplicates_removed", before - F.col("total_items")).withColumn(
        "coverage_score", coverage_score(F.col("locations"), F.col("total_items"), total_rows)
    )
    balance = []
    for category, weight in CATEGORY_WEIGHTS.items():
        share = F.col(f"n_{category}") / F.greatest(F.col("total_items"), F.lit(1))
        direction = F.when(share < weight, "under").otherwise("over")
        text = F.concat(
            F.lit(f'Category "{category}" is '), direction, F.lit("-represented ("), _percent(share),
            F.lit(f"% vs {round(weight * 100)}% target)"),
        )
        balance.append(F.when(F.abs(share - weight) > MAX_SHARE_GAP, text))
    removed = F.col("duplicates_removed")
    issues = F.array_compact(
        F.array(
            F.when(removed > 0, F.concat(F.lit("Removed "), removed.cast("string"), F.lit(" duplicate question(s)"))),
            *balance,
            F.when(
                F.col("coverage_score") < MIN_COVERAGE,
                F.concat(
                    F.lit("Low source coverage ("), _percent(F.col("coverage_score")),
                    F.lit("%) — questions reference too few records"),
                ),
            ),
            F.when(
                F.col("low_confidence") > F.col("total_items") * MAX_LOW_SHARE,
                F.concat(F.col("low_confidence").cast("string"), F.lit(" question(s) have low grounding confidence")),
            ),
        )
    )
    passed = (F.size("issues") == 0) | ((removed == 0) & (F.col("coverage_score") >= PASS_COVERAGE))
    return one.withColumn("issues", issues).select(
        passed.alias("passed"), "total_items", "duplicates_removed", "coverage_score", "low_confidence", "issues"
    )


def validate_items(items: DataFrame, total_rows: int) -> Validation:
    """Deduplicate, then check balance, coverage and confidence of what is left."""
    ensure_checkpoint_dir(items.sparkSession)
    # Items are built once; they are counted and deduplicated from there.
    items = items.checkpoint()
    kept = deduplicate(items)
    count = items.agg(F.count(F.lit(1))).scalar()
    result = summarize(kept, count, F.lit(total_rows))
    issues = result.select(F.posexplode("issues").alias("pos", "issue"))
    return Validation(kept, result.drop("issues"), issues)


def confidence_tally(items: DataFrame) -> DataFrame:
    """Items by confidence, and the number of assertions."""
    return items.groupBy("grounding_confidence").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.size("assertions")).alias("assertions")
    )
