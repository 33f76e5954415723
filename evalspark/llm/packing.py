"""Harmonic packing of token ids into sequences of a fixed capacity.

Lengths fall into classes by reciprocals of the capacity: class ``k`` holds lengths in (C/(k+1), C/k], and a bin of
class ``k`` always takes ``k`` pieces, whatever else has come. A document is cut so that its pieces nearly fill their
class: whole capacities first, then pieces of exactly C/k while the rest would leave more than 5 % of its slot empty.
Each worker fills the bins of its own partition and never waits for another. What no bin of a worker could
complete (open bins, and rests shorter than the last class) goes into a stream of rests that is cut at capacity.

The first pass is written to the shared scratch folder, so the tokenizer runs once. A worker holds at most one open
bin per class.

Defined results: a null or empty text has just the end id. Equal rows are packed as rows of their own. Columns other
than the id and the text are not carried. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.frames import frame
from evalspark.session import scratch_path

CAPACITY = 2048
END_ID = 1
CLASSES = 16
FILL = 0.95
# Rests of this many tokens share one stream, which leaves at most one sequence part-filled.
STREAM_TOKENS = 1 << 16
_CACHED_WORDS = 600_000
_WIDE_SPACE = re.compile(r"\s\s")

PIECE_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, bin long, offset long, n long, ids binary"
)


def cut(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """``(length, class)`` of the pieces of a document in order; class 0 is the stream of rests."""
    whole, rest = divmod(tokens, capacity)
    out = [(capacity, 1)] * whole
    while rest:
        k = capacity // rest
        if k > classes:
            out.append((rest, 0))
            break
        if k == classes or k * rest >= FILL * capacity:
            out.append((rest, k))
            break
        size = capacity // (k + 1)
        out.append((size, k + 1))
        rest -= size
    return out


class Encoder:
    """Token ids of whole texts by a byte-level vocabulary, with a bounded cache of words.

    The vocabulary's pattern splits a text before each single space and around each single line break, whatever else
    stands beside them, as long as no two white-space characters touch. Such a text is looked up word by word, where a
    word starts with its space or line break; new words are encoded in one go and parted at the tokens that start with
    either. Any other text is encoded whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._starts = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self._starts[[rank for token, rank in ranks.items() if token[:1] in (b" ", b"\n")]] = True
        self._words: dict[str, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4")

    def _learn(self, words: set[str]) -> None:
        if len(self._words) + len(words) > _CACHED_WORDS:
            self._words.clear()
        # A word that ends in white space would touch the next one.
        joined = [w for w in words if not w[-1:].isspace() and w]
        ids = self._encode("".join([w if w[0] == "\n" else " " + w for w in joined]))
        starts = np.flatnonzero(self._starts[ids])
        if len(starts) != len(joined):
            raise ValueError("words and tokens don't start together")
        whole, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), len(ids) * 4]
        at = 0
        for w, end in zip(joined, ends):
            self._words[w] = whole[at:end]
            at = end
        for w in words.difference(joined):
            self._words[w] = self._encode(w if w[:1] == "\n" else " " + w).tobytes()

    def ids(self, text: str) -> np.ndarray:
        """The ids of ``text`` and the end id."""
        if not text or text[0].isspace() or _WIDE_SPACE.search(text):
            found = self._encode(text)
        else:
            # The first word is looked up behind a line break, which is then left out.
            words = ("\n" + text.replace("\n", " \n")).split(" ")
            try:
                found = b"".join(map(self._words.__getitem__, words))
            except KeyError:
                missing = set(words).difference(self._words)
                if len(self._words) + len(missing) > _CACHED_WORDS:
                    missing = set(words)
                self._learn(missing)
                found = b"".join(map(self._words.__getitem__, words))
            found = np.frombuffer(found, dtype="<u4")[1:]
        return np.append(found, np.uint32(END_ID))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Bins:
    """The open bins of one worker, one per class."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.done = capacity, {}, 0
        self.rows: list[tuple] = []

    def add(self, piece: tuple, ids: np.ndarray, k: int) -> None:
        """``piece`` is (doc_id, start, length, crc, doc_tokens)."""
        if not k:
            self.rest(piece, ids)
            return
        held = self.open.setdefault(k, [])
        held.append((piece, ids))
        if len(held) == k:
            at = 0
            for one, _ in held:
                self.rows.append((*one, self.done, at, None))
                at += one[2]
            self.done += 1
            self.open[k] = []

    def rest(self, piece: tuple, ids: np.ndarray) -> None:
        self.rows.append((*piece, None, None, ids.tobytes()))

    def close(self) -> None:
        for held in self.open.values():
            for piece, ids in held:
                self.rest(piece, ids)
        self.open = {}


def _first_pass(docs: DataFrame, key: str, text: str, path: str, capacity: int) -> DataFrame:
    names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, bins = encoder(path), Bins(capacity)
        part, n = TaskContext.get().partitionId(), 0

        def taken() -> pd.DataFrame:
            nonlocal n
            rows, bins.rows = bins.rows, []
            out = frame([(*r[:5], part, *r[5:7], n + i, r[7]) for i, r in enumerate(rows)], names, ("doc_id", "bin", "offset"))
            n += len(rows)
            return out

        for docs in batches:
            for doc, whole in zip(docs["k"], docs["t"]):
                ids = encode.ids(whole)
                start = 0
                for size, k in cut(len(ids), capacity):
                    own = ids[start : start + size]
                    bins.add((None if pd.isna(doc) else int(doc), start, size, zlib.crc32(own.tobytes()), len(ids)), own, k)
                    start += size
                if len(bins.rows) > 20_000:
                    yield taken()
            yield taken()
        bins.close()
        yield taken()

    chosen = docs.select(F.col(f"`{key}`").cast("long").cast("string").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    return chosen.mapInPandas(pieces, PIECE_SCHEMA)


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY
) -> DataFrame:
    """One row per piece: its document, place there, checksum of its ids, sequence and place there.

    ``tokenizer`` is the path of a byte-level vocabulary as ranks.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    _first_pass(docs, key, text, tokenizer, capacity).write.parquet(path)
    rows = spark.read.parquet(path)
    full = rows.filter(F.col("bin").isNotNull()).withColumn("sequence_id", F.shiftleft("part", 32) + F.col("bin"))

    rests = rows.filter(F.col("bin").isNull())
    total = rests.agg(F.sum("length")).first()[0] or 0
    streams = max(1, -(-total // STREAM_TOKENS))
    # The rests of a partition stay beside each other only by chance; the streams are alike in size.
    dealt = rests.withColumn("stream", F.pmod(F.xxhash64("part", "n"), F.lit(streams)))
    order = Window.partitionBy("stream").orderBy("part", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_end", F.sum("length").over(order)).withColumn("_begin", F.col("_end") - F.col("length"))
    cap = F.lit(capacity)
    slices = placed.withColumn(
        "_seq", F.explode(F.sequence(F.floor(F.col("_begin") / cap), F.floor((F.col("_end") - 1) / cap)))
    ).withColumns(
        {
            "_from": F.greatest(F.col("_begin"), F.col("_seq") * cap),
            "_to": F.least(F.col("_end"), (F.col("_seq") + 1) * cap),
        }
    )
    skipped, size = F.col("_from") - F.col("_begin"), F.col("_to") - F.col("_from")
    part_ids = F.substring(F.col("ids"), (skipped * 4 + 1).cast("int"), (size * 4).cast("int"))
    rest_rows = slices.select(
        "doc_id",
        (F.col("start") + skipped).alias("start"),
        size.alias("length"),
        F.crc32(part_ids).alias("ids_crc32"),
        "doc_tokens",
        (F.lit(1 << 62) + F.shiftleft("stream", 24) + F.col("_seq")).alias("sequence_id"),
        (F.col("_from") - F.col("_seq") * cap).alias("offset"),
    )
    return full.select(*rest_rows.columns).unionByName(rest_rows)
