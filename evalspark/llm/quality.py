"""Quality rules: a table of thresholds compiled into one Spark projection.

Every metric is a built-in column expression over the words and lines of one text, so the job is a single scan
without shuffle or user functions.

Defined results: a null text has no words and no lines; it and the empty text fail ``min_words``. Repeated rows are
judged alike, each on its own. Columns named like a metric are replaced, all others stay. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r]+"
WORD_START = r"[^ \t-\r]"
SYMBOLS = r"[#*$%&|<>]"
SHINGLE = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au aux avec ce dans de des du en et est la le les ne pas pour que qui sur un une "
    "als auf aus bei das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "como con del el es las los más no para por se su sus un una y"
).split()


@dataclass(frozen=True)
class Rule:
    """``lower <= value <= upper`` for texts of at least ``from_words`` words; ``value`` is SQL over the metrics."""

    name: str
    value: str
    lower: float | None = None
    upper: float | None = None
    from_words: int = 0

    def failed(self) -> Column:
        value = F.expr(self.value)
        out = F.lit(False)
        if self.lower is not None:
            out = out | (value < F.lit(self.lower))
        if self.upper is not None:
            out = out | (value > F.lit(self.upper))
        if self.from_words:
            out = out & (F.col("n_words") >= self.from_words)
        return F.coalesce(out, F.lit(False))


# What every text must pass; the rest of the table is the policy and may be replaced by the caller.
BASE_RULES = (
    Rule("min_words", "n_words", lower=10),
    Rule("repeated_words", "100 * n_repeat_words - 20 * n_words", upper=0),
)

RULES = (
    Rule("mean_word_length", "word_chars / nullif(n_words, 0)", lower=2, upper=16, from_words=1),
    Rule("symbol_ratio", "n_symbols / nullif(n_words, 0)", upper=0.1, from_words=1),
    Rule("letter_words", "n_letter_words / nullif(n_words, 0)", lower=0.5, from_words=1),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", lower=0.01, from_words=100),
    Rule("duplicate_lines", "n_dup_lines / nullif(n_lines, 0)", upper=0.5, from_words=1),
    Rule("bullet_lines", "n_bullet_lines / nullif(n_lines, 0)", upper=0.9, from_words=1),
    Rule("ellipsis_lines", "n_ellipsis_lines / nullif(n_lines, 0)", upper=0.5, from_words=1),
)

METRICS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_letter_words",
    "n_stop_words",
    "n_bullet_lines",
    "n_ellipsis_lines",
)


def _long(value: Column) -> Column:
    return value.cast("long")


def _count(values: Column, test) -> Column:
    return _long(F.size(F.filter(values, test)))


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the metric columns.

    Windows of five words are compared by a 64-bit hash. Only a text in which some hash occurs twice sorts its
    windows to find the repeated ones; each sorted window then looks at its two neighbours, so the work stays
    proportional to the text but for the sort.
    """
    # The row travels in a struct, so that no name of its own can clash with those in between.
    own = [c for c in docs.columns if c.lower() not in METRICS]
    kept = [F.col(f"_row.`{c}`").alias(c) for c in own]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    staged = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"),
        F.filter(F.split(whole, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD_START)).alias("_lines"),
        F.length(whole).alias("_length"),
        _long(F.regexp_count(whole, F.lit(SYMBOLS))).alias("n_symbols"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    size = F.size(words)
    window = F.transform(
        F.sequence(F.lit(0), size - SHINGLE),
        lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]),
    )
    staged = staged.withColumn("_windows", F.when(size >= SHINGLE, window).otherwise(F.array().cast("array<long>")))
    windows = F.col("_windows")
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    staged = staged.withColumn("_sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), ordered))
    by_hash = F.col("_sorted")
    repeated = F.filter(
        by_hash,
        lambda x, i: F.coalesce(x["h"] == F.get(by_hash, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(by_hash, i + 1)["h"], F.lit(False)),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["p"])),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct(
            (acc["n"] + SHINGLE - F.greatest(F.lit(0), acc["end"] - p)).alias("n"), (p + SHINGLE).alias("end")
        ),
        lambda acc: acc["n"],
    )
    return staged.select(
        *kept,
        # The partition number keeps a filter on the verdict above this projection: pushed below, it would repeat
        # the windows inside of the functions that walk over them.
        _long(size + F.spark_partition_id() * 0).alias("n_words"),
        _long(F.length(F.array_join(words, ""))).alias("word_chars"),
        "n_symbols",
        _long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        _long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
        _long(F.size(lines)).alias("n_lines"),
        _count(words, lambda w: w.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]")).alias("n_letter_words"),
        _count(words, lambda w: F.lower(w).isin(*STOP_WORDS)).alias("n_stop_words"),
        _count(lines, lambda line: line.rlike(r"^[ \t]*[-*•] ")).alias("n_bullet_lines"),
        _count(lines, lambda line: line.rlike(r"(\.\.\.|…)[ \t\r]*\z")).alias("n_ellipsis_lines"),
    )


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the metrics, ``failed_rules`` (array of names), ``base_failed`` and ``kept``."""
    measured = with_metrics(docs, text).drop("failed_rules", "base_failed", "kept")
    base = F.lit(False)
    for rule in BASE_RULES:
        base = base | rule.failed()
    names = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in (*BASE_RULES, *rules)]))
    return (
        measured.withColumns({"failed_rules": names, "base_failed": base})
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass every rule, with their own columns.

    The columns travel in a struct beside the judged text, so that names which clash with metrics keep their values.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    judged = judge(packed.withColumn("_text", F.col(f"_row.`{text}`")), rules, "_text")
    return judged.filter("kept").select("_row.*")
