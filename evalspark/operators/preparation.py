"""Evaluation rows: header aliases, required values, assertion lookup, prompts, answers and scores."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.text import normalize_prompt, trim_ws
from evalspark.operators.joins import lookup_join
from evalspark.session import scratch_path

# Accepted column names (trimmed, lower-case) of evaluation files.
HEADER_ALIASES = {
    "prompt": "prompt",
    "question": "prompt",
    "expectedanswer": "expected_answer",
    "expected_answer": "expected_answer",
    "expected answer": "expected_answer",
    "sourcelocation": "source_location",
    "source_location": "source_location",
    "source location": "source_location",
    "actualanswer": "actual_answer",
    "actual_answer": "actual_answer",
    "actual answer": "actual_answer",
}
SCORE_ALIASES = {
    "similarity_score": "similarity_score",
    "similarity score": "similarity_score",
    "similarityscore": "similarity_score",
}
REQUIRED = ("prompt", "expected_answer", "source_location")
ERROR_MARK = "[ERROR:"

ASSERTION = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("values", T.ArrayType(T.StringType())),
        T.StructField("whole_word", T.BooleanType()),
    ]
)

TextFunction = Callable[[list[str]], list[str]]


def map_headers(headers: list[str], with_score: bool = False) -> dict[str, str]:
    """Raw header -> canonical column. Raises when a required column is missing."""
    aliases = HEADER_ALIASES | SCORE_ALIASES if with_score else HEADER_ALIASES
    spelled = {raw: raw.strip().lower() for raw in headers}
    by_meaning = {name: [raw for raw in headers if aliases.get(spelled[raw]) == name] for name in dict.fromkeys(aliases.values())}
    absent = [name for name in REQUIRED if not by_meaning[name]]
    if absent:
        raise ValueError(f"no column for {' / '.join(absent)} among {headers}")
    return {raw: name for name, found in by_meaning.items() for raw in found}


def deduplicate_headers(headers: list[str]) -> list[str]:
    """Repeated names (ignoring case) are numbered ``_dup1``, ``_dup2`` ... from the second on."""
    folded = [h.lower() for h in headers]
    earlier = [folded[:i].count(name) for i, name in enumerate(folded)]
    return [f"{h}_dup{n}" if n else h for h, n in zip(headers, earlier)]


def normalize_rows(df: DataFrame, with_score: bool = False) -> DataFrame:
    """Project any accepted header spelling to the four text columns; other columns are kept as they are.

    Of several columns with the same meaning the last one that has a value wins; null becomes ''.
    """
    mapping = map_headers(df.columns, with_score)
    sources: dict[str, list[str]] = {}
    for raw, canonical in mapping.items():
        sources.setdefault(canonical, []).append(raw)
    projected = []
    for canonical in (*REQUIRED, "actual_answer"):
        cells = [F.col(f"`{raw}`").cast("string") for raw in reversed(sources.get(canonical, []))]
        projected.append(F.coalesce(*cells, F.lit("")).alias(canonical))
    if with_score and "similarity_score" in sources:
        raw_score = F.col(f"`{sources['similarity_score'][-1]}`").cast("string")
        projected.append(F.bround(raw_score.try_cast("double")).cast("int").alias("similarity_score"))
    others = [F.col(f"`{c}`") for c in df.columns if c not in mapping]
    return df.select(*projected, *others)


def _blank(column: str) -> Column:
    return F.col(column).isNull() | (trim_ws(F.col(column)) == "")


def missing_fields(df: DataFrame) -> DataFrame:
    """Add ``missing``: the required columns that are blank in the row."""
    found = F.array_compact(F.array(*[F.when(_blank(c), F.lit(c)) for c in REQUIRED]))
    return df.withColumn("missing", found)


def split_incomplete(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(complete rows, rejected rows with their missing fields)``; strict mode raises on any rejection."""
    checked = missing_fields(df)
    rejected = checked.filter(F.size("missing") > 0)
    if strict:
        count = rejected.count()
        if count:
            raise ValueError(f"{count} row(s) are missing required field(s)")
    return checked.filter(F.size("missing") == 0).drop("missing"), rejected


def prompt_key(prompt: Column) -> Column:
    return F.lower(trim_ws(prompt))


def attach_assertions(rows: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Left-join the assertions of ``sidecar(ord, prompt, assertions)`` by trimmed, lower-cased prompt.

    Items without assertions are ignored and the last of several items with one prompt wins. Prompts
    may repeat without limit on the row side, so the lookup splits off hot keys.
    """
    usable = sidecar.filter((F.size("assertions") > 0) & (F.col("prompt") != ""))
    last = (
        usable.withColumn("_key", F.sha2(prompt_key(F.col("prompt")), 256))
        .groupBy("_key")
        .agg(F.max_by("assertions", "ord").alias("assertions"))
    )
    keyed = rows.drop("assertions").withColumn("_key", F.sha2(prompt_key(F.col("prompt")), 256))
    return lookup_join(keyed, last, "_key", "left").drop("_key")


def assemble_prompt(prompt: Column, system_prompt: str | None = None, instruction: str | None = None) -> Column:
    """The caller's instruction (such as which connector to search), system prompt and question, between blank lines."""
    return F.concat_ws("\n\n", *[F.lit(part) for part in (instruction, system_prompt) if part], prompt)


def resolve_system_prompt(inline: str | None = None, file_text: str | None = None) -> str | None:
    """Inline text beats the text of a prompt file, which is trimmed."""
    if inline:
        return inline
    return file_text.strip() if file_text is not None else None


def call_per_row(
    df: DataFrame, source: str, target: str, fn: TextFunction, failure: Callable[[Exception], str],
    partitions: int | None = None, delay_seconds: float = 0.0, batch: int = 1,
) -> DataFrame:
    """Replace ``target`` by ``fn`` applied to ``source`` on the workers.

    ``partitions`` bounds how many calls run at once. A failing call, or one with missing replies, becomes
    ``failure(error)`` for the texts of its batch only. The result is written to the shared scratch folder at once, so
    that no later use of it repeats the calls; only a lost task repeats its own.
    """
    schema = T.StructType(
        [f for f in df.schema.fields if f.name != target] + [T.StructField(target, T.StringType())]
    )
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = frame[source].tolist()
            replies: list[str] = []
            for start in range(0, len(texts), batch):
                part = texts[start : start + batch]
                try:
                    answers = list(fn(part))
                    if len(answers) != len(part) or any(a is None for a in answers):
                        raise ValueError(f"{len(part)} replies expected, {sum(a is not None for a in answers)} given")
                    replies.extend(answers)
                except Exception as error:  # noqa: BLE001 - the error is data here
                    replies.extend([failure(error)] * len(part))
                if delay_seconds:
                    time.sleep(delay_seconds)
            frame = frame.drop(columns=[target], errors="ignore")
            frame[target] = replies
            yield frame[names]

    spread = df.repartition(partitions) if partitions else df
    path = scratch_path(df.sparkSession, "replies")
    spread.mapInPandas(run, schema).write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def answer_prompts(
    rows: DataFrame, fn: TextFunction, system_prompt: str | None = None, instruction: str | None = None,
    partitions: int | None = None, delay_seconds: float = 0.0, batch: int = 1,
) -> DataFrame:
    """Fill blank ``actual_answer`` values; answered rows pass through without touching Python.

    Replies are trimmed and a failing call leaves ``[ERROR: message]`` as the answer.
    """
    answered = F.col("actual_answer").isNotNull() & (F.col("actual_answer") != "")
    pending = rows.filter(~answered).withColumn(
        "_prompt", assemble_prompt(F.col("prompt"), system_prompt, instruction)
    )
    replied = call_per_row(
        pending, "_prompt", "actual_answer", fn, lambda e: f"{ERROR_MARK} {e}]", partitions, delay_seconds, batch
    ).withColumn("actual_answer", trim_ws(F.col("actual_answer")))
    return rows.filter(answered).unionByName(replied.select(*rows.columns))


def unusable_answer(answer: Column) -> Column:
    """Blank answers and error answers are neither judged nor checked."""
    return answer.isNull() | (answer == "") | answer.startswith(ERROR_MARK)


def parse_score(reply: Column) -> Column:
    """First run of digits, clamped to 0..100; 0 where there is none."""
    digits = F.regexp_extract(reply, "([0-9]+)", 1).try_cast("double")
    return F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), digits)), F.lit(0.0)).cast("int")


def token_overlap_score(expected: Column, actual: Column) -> Column:
    """Offline judge: Jaccard overlap of the word sets, 0..100."""
    left = F.array_distinct(F.split(normalize_prompt(expected), " "))
    right = F.array_distinct(F.split(normalize_prompt(actual), " "))
    union = F.size(F.array_union(left, right))
    return F.round(F.lit(100.0) * F.size(F.array_intersect(left, right)) / F.greatest(union, F.lit(1))).cast("int")


def score_answers(
    rows: DataFrame, judge: TextFunction | None = None, judge_prompt: Callable[[Column, Column], Column] | None = None,
    partitions: int | None = None, delay_seconds: float = 0.0, batch: int = 1,
) -> DataFrame:
    """Fill null ``similarity_score`` values.

    Scored rows stay as they are and unusable answers score 0 without a call. The rest goes to
    ``judge`` (a callable over prompts whose replies are parsed) or, without one, to the word-overlap
    judge, which stays in the JVM.
    """
    if "similarity_score" not in rows.columns:
        rows = rows.withColumn("similarity_score", F.lit(None).cast("int"))
    score = F.col("similarity_score")
    unusable = unusable_answer(F.col("actual_answer"))
    if judge is None:
        overlap = token_overlap_score(F.col("expected_answer"), F.col("actual_answer"))
        return rows.withColumn(
            "similarity_score", F.when(score.isNotNull(), score).when(unusable, 0).otherwise(overlap)
        )
    if judge_prompt is None:
        def judge_prompt(expected, actual):
            return F.concat(F.lit("Expected Answer: "), expected, F.lit("\n\nActual Answer: "), actual)
    settled = rows.filter(score.isNotNull() | unusable).withColumn("similarity_score", F.coalesce(score, F.lit(0)))
    pending = rows.filter(score.isNull() & ~unusable).withColumn(
        "_prompt", judge_prompt(F.col("expected_answer"), F.col("actual_answer"))
    )
    judged = call_per_row(pending, "_prompt", "_reply", judge, lambda e: "", partitions, delay_seconds, batch)
    judged = judged.withColumn("similarity_score", parse_score(F.col("_reply")))
    return settled.unionByName(judged.select(*settled.columns))


def pending_rows(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key has no finished result yet; an unfinished result has a null score."""
    finished = done.filter(F.col("similarity_score").isNotNull()).select(key).distinct()
    return rows.join(finished, key, "left_anti")


def resume(rows: DataFrame, done: DataFrame, run: Callable[[DataFrame], DataFrame], key: str = "id") -> DataFrame:
    """Run only what is missing and return it together with the finished results."""
    fresh = run(pending_rows(rows, done, key))
    kept = done.filter(F.col("similarity_score").isNotNull())
    return kept.unionByName(fresh, allowMissingColumns=True)


def warn_version(version: str | None) -> None:
    if version and not version.startswith("1."):
        warnings.warn(f"eval set version {version} may not be compatible", stacklevel=2)


