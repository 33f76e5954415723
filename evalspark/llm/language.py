"""Language of pages by fusing evidence with Bayes' rule.

The text's likelihood comes from a multinomial model over hashed character n-grams, fitted on a bounded sample of
labelled documents. A first pass over all pages scores their visible text. Grouped sums of those scores then give, over
the whole corpus, how far the language declared in the markup and the address suffix can be trusted, and a prior for
each host that falls back on its domain and on all pages where the host has few. The posterior multiplies them all.
A page's own score is taken out of the host's sums before they serve as its prior.

Pages are scored once and kept as narrow rows. The sums are partial aggregates; the pages join them by host, domain,
declared language and suffix, where adaptive execution splits a frequent value.

Defined results: a null page or address counts as empty. A page without text is judged by the rest, one without any
evidence by the corpus. Repeated rows are judged alike. Other columns are not carried. An empty table gives an empty
table; without labelled documents there is no language and ``language`` is null.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.frames import frame
from evalspark.session import scratch_path

BUCKETS = 1 << 13
#: Labelled rows per language that the text model is fitted on.
SAMPLE_PER_LANGUAGE = 400
#: Text counts as at most this many n-grams, as neighbours in a text are far from independent.
EFFECTIVE_GRAMS = 60.0
#: Pages that weigh as much as the next level's prior; imagined pages per value of a discrete clue.
PRIOR_PAGES = 5.0
CLUE_PAGES = 1.0

_HIDES = re.compile(r"(?i)<(?:(script|style|noscript|template)\b|!--)")
_TAG = re.compile(r"<[^>]*>")
_ROOT = re.compile(r"(?i)<html\b")
_LANGUAGE = re.compile(r"""(?i)\blang\s*=\s*["']?([a-z]{2,3})\b""")
_SPACE = re.compile(r"[\W\d_]+")

SCORED_SCHEMA = "page_id long, host string, domain string, suffix string, declared string, grams long, loglik array<double>"


def _without_hidden(page: str) -> str:
    """``page`` with a blank for each comment and each element whose content isn't shown. What is never closed stays.

    Once an end isn't found behind a place it isn't looked for again, so each character is read a few times at most.
    """
    out, at, missing = [], 0, set()
    while found := _HIDES.search(page, at):
        name = (found[1] or "").casefold()
        end = None
        if name not in missing:
            end = re.compile(rf"(?i)</{name}\s*>" if name else "-->").search(page, found.end())
            if end is None:
                missing.add(name)
        out.append(page[at : found.start() if end else found.end()])
        if end:
            out.append(" ")
        at = end.end() if end else found.end()
    return "".join(out) + page[at:]


def visible_text(page: str) -> str:
    shown = _without_hidden(page)
    # Behind the last closing bracket there is no tag.
    last = shown.rfind(">") + 1
    return entities.unescape(_TAG.sub(" ", shown[:last]) + shown[last:])


def declared_language(page: str) -> str:
    at = 0
    while root := _ROOT.search(page, at):
        end = page.find(">", root.end())
        end = len(page) if end < 0 else end
        found = _LANGUAGE.search(page, root.end(), end)
        if found:
            return found[1].lower()
        # Other roots before this bracket have the same text behind them.
        at = end
    return ""


def address_parts(url: str) -> tuple[str, str, str]:
    """``(host, domain, suffix)``; the domain is the last two labels."""
    try:
        host = (urlsplit(url).hostname or "").lower()
    except ValueError:
        host = ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1] if len(labels) > 1 else ""


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of one to three characters, over the letters of the text with single blanks."""
    codes = np.frombuffer((" " + _SPACE.sub(" ", text).strip().lower() + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(BUCKETS, dtype=np.int64)
    if len(codes) < 3:
        return out
    hashed = np.zeros(len(codes), dtype=np.uint64)
    for size in (1, 2, 3):
        count = len(codes) - size + 1
        hashed = (hashed[:count] * np.uint64(0x9E3779B97F4A7C15) + codes[size - 1 :] + np.uint64(size)) * np.uint64(0xD6E8FEB86659FD93)
        out += np.bincount((hashed >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return out


@dataclass
class TextModel:
    """Logarithms of n-gram probabilities, one row per language."""

    languages: list[str]
    logs: np.ndarray

    def loglik(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams, and the tempered log-likelihoods relative to the best."""
        counts = gram_counts(text)
        total = int(counts.sum())
        scores = self.logs @ counts
        if total:
            scores = scores * min(1.0, EFFECTIVE_GRAMS / total)
        return total, scores - (scores.max() if len(scores) else 0.0)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> TextModel:
    """The model of a repeatable sample of at most ``per_language`` rows of each language.

    Ids are chosen first, on two narrow columns; the sample's texts are then read by a join with those few ids.
    """
    from pyspark.sql import Window

    ids = labelled.filter(F.col(label).isNotNull()).select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").alias("l"))
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("k"), "k"))
    chosen = ids.withColumn("r", rank).filter(F.col("r") <= per_language).select("k", "l").distinct()
    sample = labelled.join(F.broadcast(chosen), (F.col(f"`{key}`") == F.col("k")) & (F.col(f"`{label}`") == F.col("l"))).select(
        "l", F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    )

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for lang, rows in frame.groupby("l"):
                counts = sum(gram_counts(t) for t in rows["t"])
                at = np.flatnonzero(counts)
                yield pd.DataFrame({"l": lang, "bucket": at, "n": counts[at]})

    # At most languages x buckets rows.
    found = sample.mapInPandas(count, "l string, bucket long, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["l"].unique())
    counts = np.full((len(languages), BUCKETS), 0.5)
    counts[[languages.index(x) for x in found["l"]], found["bucket"]] += found["n"]
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def score(pages: DataFrame, model: TextModel) -> DataFrame:
    """One narrow row per page with its clues and the text's log-likelihoods, written once."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c.split()[0] for c in SCORED_SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"]):
                grams, loglik = shared.value.loglik(visible_text(page))
                rows.append((page_id, *address_parts(url), declared_language(page), grams, loglik.tolist()))
            yield frame(rows, names, ("page_id",))

    path = scratch_path(spark, "scored")
    chosen = pages.select(
        F.col("page_id").cast("long").cast("string").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    chosen.mapInPandas(read, SCORED_SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def _sums(rows: DataFrame, by: str, size: int) -> DataFrame:
    return rows.groupBy(by).agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(size)]).alias(f"by_{by}"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _smoothed(counts: Column, prior: Column) -> Column:
    """Shares of ``counts`` with ``PRIOR_PAGES`` pages' worth of ``prior``."""
    total = _total(counts) + F.lit(PRIOR_PAGES)
    return F.zip_with(counts, prior, lambda n, p: (n + F.lit(PRIOR_PAGES) * p) / total)


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """``(page_id, language, confidence, text_language, declared, host)`` per page."""
    size = len(model.languages)
    scored = score(pages, model)
    if not size:
        none = F.lit(None).cast("string")
        return scored.select("page_id", none.alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), "declared", "host")
    likely = F.transform("loglik", lambda x: F.exp(x))
    rows = scored.withColumn("likely", likely).withColumn("p", F.transform("likely", lambda x: x / _total(F.col("likely"))))

    # Languages of the whole corpus, and how many values each clue has: a handful of numbers.
    totals = rows.agg(
        *[F.sum(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(size)],
        F.approx_count_distinct("declared").alias("declared"),
        F.approx_count_distinct("suffix").alias("suffix"),
    ).first()
    counts = [float(totals[f"p{i}"] or 0.0) for i in range(size)]
    corpus = F.array(*[F.lit((n + 1.0) / (sum(counts) + size)) for n in counts])
    language_pages = F.array(*[F.lit(n) for n in counts])

    joined = rows
    for by in ("host", "domain", "declared", "suffix"):
        joined = joined.join(_sums(rows, by, size), by, "left")

    def without_own(values: Column) -> Column:
        return F.zip_with(values, F.col("p"), lambda n, p: F.greatest(n - p, F.lit(0.0)))

    def clue(values: Column, kinds: int) -> Column:
        """P(value | language), the page itself left out."""
        return F.zip_with(
            without_own(values),
            without_own(language_pages),
            lambda n, all_pages: (n + F.lit(CLUE_PAGES)) / (all_pages + F.lit(CLUE_PAGES * max(kinds, 1))),
        )

    joined = joined.withColumn("domain_prior", _smoothed(without_own(F.col("by_domain")), corpus))
    joined = joined.withColumn("prior", _smoothed(without_own(F.col("by_host")), F.col("domain_prior")))
    parts = (F.col("likely"), F.col("prior"), clue(F.col("by_declared"), totals["declared"]), clue(F.col("by_suffix"), totals["suffix"]))
    weight = parts[0]
    for part in parts[1:]:
        weight = F.zip_with(weight, part, lambda a, b: a * b)
    joined = joined.withColumn("weight", weight).withColumn("best", F.array_max("weight"))
    names = F.array(*[F.lit(x) for x in model.languages])
    return joined.select(
        "page_id",
        F.get(names, F.array_position("weight", F.col("best")).cast("int") - 1).alias("language"),
        F.round(F.col("best") / _total(F.col("weight")), 4).alias("confidence"),
        F.when(F.col("grams") > 0, F.get(names, F.array_position("loglik", F.lit(0.0)).cast("int") - 1)).alias("text_language"),
        "declared",
        "host",
    )
