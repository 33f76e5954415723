"""Splitting long texts into records of about 500 characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.text import collapse_space, trim_ws, word_count

CHUNK_CHARS = 500
SECTION_BREAK = r"(?m)\n{2,}|(?=^#{1,3}\s)"


def chunk_starts(pieces: Column, separator: str, limit: int = CHUNK_CHARS) -> Column:
    """First piece (from 1) of each chunk of a greedy packing; a chunk closes before it would pass ``limit``.

    The separator after each piece counts, and a piece longer than the limit stays whole.
    """
    gap = len(separator)
    # The fold looks at lengths only and records where each chunk starts; texts are joined once per chunk.
    begin = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("size"), F.lit(1).alias("at"))

    def step(state, length):
        full = (state["size"] + length > limit) & (state["size"] > 0)
        opens = full | (state["at"] == 1)
        return F.struct(
            F.when(opens, F.array_append(state["starts"], state["at"])).otherwise(state["starts"]).alias("starts"),
            (F.when(full, 0).otherwise(state["size"]) + length + gap).alias("size"),
            (state["at"] + 1).alias("at"),
        )

    return F.aggregate(F.transform(pieces, F.length), begin, step, lambda state: state["starts"])


def chunk_texts(starts: Column, pieces: Column, separator: str) -> Column:
    """The trimmed text of each chunk, given where the chunks start."""
    following = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(F.size(pieces) + 1))
    return F.zip_with(
        starts, following, lambda lo, hi: trim_ws(F.array_join(F.slice(pieces, lo, hi - lo), separator))
    )


def text_sections(text: Column) -> Column:
    """Pieces at blank lines and before headings of one to three ``#``; blank pieces are dropped.

    The pattern is only run on texts that hold a blank line or a ``#``.
    """
    split = (
        F.when(F.contains(text, F.lit("#")), F.split(text, SECTION_BREAK))
        .when(F.contains(text, F.lit("\n\n")), F.split(text, "\n{2,}"))
        .otherwise(F.array(text))
    )
    return F.filter(split, lambda s: trim_ws(s) != "")


def word_chunks(spaced: Column, limit: int = CHUNK_CHARS) -> Column:
    """Texts of a greedy packing of the words of a text whose white space is collapsed.

    With single spaces between words a chunk is the longest stretch of at most ``limit`` characters that ends
    at a word end, or one longer word, so one regular expression finds all of them. White space in front of
    the first word counts as an empty piece with a separator; such texts go through the general fold.
    """
    pattern = rf"(?s)([^ ]{{{limit + 1},}}|[^ ].{{0,{limit - 1}}}(?![^ ]))"
    pieces = F.split(spaced, " ")
    return F.when(~spaced.startswith(" "), F.regexp_extract_all(spaced, F.lit(pattern), 1)).otherwise(
        chunk_texts(chunk_starts(pieces, " ", limit), pieces, " ")
    )


def chunk_rows(df: DataFrame, ids: list[str], pieces: Column, separator: str, limit: int = CHUNK_CHARS) -> DataFrame:
    """``ids, chunk_number (from 1), content, word_count``; numbering restarts per input row.

    A last chunk that is blank after trimming is dropped; an inner one is kept, as it takes its number.
    """
    split = df.select(*ids, pieces.alias("_pieces")).withColumn("_starts", chunk_starts(F.col("_pieces"), separator, limit))
    packed = split.select(*ids, F.posexplode_outer(chunk_texts(F.col("_starts"), F.col("_pieces"), separator)).alias("_pos", "content"), F.size("_starts").alias("_n"))
    kept = packed.filter((F.col("content") != "") | (F.col("_pos") + 1 < F.col("_n")))
    return kept.select(*ids, (F.col("_pos") + 1).alias("chunk_number"), "content", word_count(F.col("content")).alias("word_count"))


def chunk_sections(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    return chunk_rows(df, ids, text_sections(F.col(text)), "\n\n")


def chunk_words(df: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    # Separate steps keep each expression from being evaluated more than once; an inner posexplode would
    # add a filter that evaluates the chunks a second time.
    spaced = df.select(*ids, F.rtrim(collapse_space(F.col(text))).alias("_spaced"))
    chunks = spaced.select(*ids, word_chunks(F.col("_spaced")).alias("_chunks"))
    packed = chunks.select(*ids, F.posexplode_outer("_chunks").alias("_pos", "content"), F.size("_chunks").alias("_n"))
    kept = packed.filter((F.col("content") != "") | (F.col("_pos") + 1 < F.col("_n")))
    spaces = F.length("content") - F.length(F.replace("content", F.lit(" "), F.lit("")))
    return kept.select(*ids, (F.col("_pos") + 1).alias("chunk_number"), "content", (spaces + 1).alias("word_count"))
