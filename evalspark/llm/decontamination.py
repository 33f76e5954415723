"""Benchmark decontamination: a prefix-filtered set join with exact containment of item-sized windows.

Each window of an item (ten words, or the whole of a shorter item) is a set of word shingles. A document can contain
the window only if it contains every shingle, so one necessary shingle per window is enough to find candidates: the
rarest by its count over all documents. Documents are joined on those prefix shingles; the shingle's place in the
window fixes where the window would begin, which must leave room for all of it (length and position bounds), and
the words there are compared with the window's words.

Windows are held in blocks of bounded size, written to the shared scratch folder. A task goes through the blocks for
each batch of whole texts, so any number of items is joined in one pass with the memory of one block, no row leaves
its task, and no shingle or document can become a hot key. Where one block holds everything it stays loaded.

Defined results: a null text, or one without words, has no words and no hits. Items without words are ignored. Repeated
items count once per id, null ids not at all; repeated documents are judged alike. Columns named like a result are
replaced, all others stay. An empty table of documents or items gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.files import local_uri
from evalspark.session import scratch_path

WINDOW = 10
SHINGLE = 3
# Words of all windows in one block: about 100 MB of Python objects and arrays.
BLOCK_WORDS = 2_000_000
_SLICE = 200_000

# Letters in lower case, digits and everything beyond ASCII are words; other ASCII separates them.
_KEEP = bytes(
    c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isascii() and chr(c).isupper() else 32
    for c in range(256)
)
WORDS_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_KEEP).split() if text else []


def _lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(item, window, words)``: every window of every item with at least one word."""
    words = F.regexp_extract_all(_lower(F.col(f"`{text}`")), F.lit(WORDS_SQL), F.lit(0))
    whole = items.select(F.col(f"`{key}`").cast("string").alias("item"), words.alias("w")).filter(
        (F.size("w") > 0) & F.col("item").isNotNull()
    )
    last = F.greatest(F.size("w") - window, F.lit(0))
    return whole.select("item", "w", F.explode(F.sequence(F.lit(0), last)).alias("window")).select(
        "item", "window", F.slice("w", F.col("window") + 1, F.lit(window)).alias("words")
    )


def _shingles(windows: DataFrame, size: int) -> DataFrame:
    """``(item, window, words, offset, shingle)``; a window shorter than a shingle is one shingle."""
    last = F.greatest(F.size("words") - size, F.lit(0))
    return windows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("offset")).withColumn(
        "shingle", F.slice("words", F.col("offset") + 1, F.lit(size))
    )


def _write_blocks(rows: DataFrame, words_per_row: int, label: str) -> list[str]:
    """Rows as Parquet files of bounded size in the shared scratch; their addresses."""
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    count = rows.count()
    rows.repartition(max(1, -(-count * words_per_row // BLOCK_WORDS))).write.parquet(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    return [local_uri(r.path) for r in files.collect()]


def _load(path: str) -> pd.DataFrame:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.parquet.read_table(name, filesystem=fs).to_pandas()


class Vocabulary:
    """Numbers of the words of one block; every other word is -1."""

    def __init__(self, rows):
        self.numbers: dict[bytes, int] = {}
        for words in rows:
            for w in words:
                self.numbers.setdefault(w.encode(), len(self.numbers))

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.numbers.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))


def _rows_at(ids: np.ndarray, table: dict[int, np.ndarray], order: dict[int, tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per shingle size: positions in ``ids`` and the matching entries of ``table``."""
    for size, shingles in table.items():
        starts = len(ids) - size + 1
        if starts <= 0:
            continue
        known = ids >= 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : k + starts] for k in range(size)]))
        if not len(at):
            continue
        code = _code(np.stack([ids[at + k] for k in range(size)], axis=1))
        keys, entries = order[size]
        low, high = np.searchsorted(keys, code), np.searchsorted(keys, code, side="right")
        found = high > low
        at, low, count = at[found], low[found], (high - low)[found]
        if len(at):
            reach = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            position, entry = np.repeat(at, count), entries[reach]
            same = np.logical_and.reduce([ids[position + k] == shingles[entry, k] for k in range(size)])
            yield position[same], entry[same]


def _code(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = (out ^ rows[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return out


class ShingleBlock:
    """Shingles to be counted."""

    def __init__(self, frame: pd.DataFrame):
        shingles = frame["shingle"].tolist()
        self.vocabulary = Vocabulary(shingles)
        self.table, self.order, self.names = _tables(self.vocabulary, shingles), {}, shingles
        for size, (numbers, entries) in self.table.items():
            code = _code(numbers)
            rank = np.argsort(code, kind="stable")
            self.order[size] = (code[rank], rank)
        self.counts = {size: np.zeros(len(n), dtype=np.int64) for size, (n, _) in self.table.items()}

    def add(self, words: list[bytes]) -> None:
        ids = self.vocabulary.of(words)
        for size, (numbers, _) in self.table.items():
            for _, entry in _rows_at(ids, {size: numbers}, self.order):
                np.add.at(self.counts[size], entry, 1)

    def taken(self) -> list[tuple[list[str], int]]:
        out = []
        for size, (_, entries) in self.table.items():
            out += [(list(self.names[entries[i]]), int(self.counts[size][i])) for i in np.flatnonzero(self.counts[size])]
        return out


def _tables(vocabulary: Vocabulary, rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows of word numbers by row length, with their places in ``rows``."""
    places: dict[int, list[int]] = {}
    for i, words in enumerate(rows):
        places.setdefault(len(words), []).append(i)
    return {
        size: (
            np.array([[vocabulary.numbers[w.encode()] for w in rows[i]] for i in at], dtype=np.int32),
            np.array(at, dtype=np.int64),
        )
        for size, at in places.items()
    }


class WindowBlock:
    """Windows with their prefix shingles, ready to be joined with documents."""

    def __init__(self, frame: pd.DataFrame):
        windows, offsets = frame["words"].tolist(), frame["offset"].to_numpy()
        self.items = frame["items"].tolist()
        self.vocabulary = Vocabulary(windows)
        self.width = max(map(len, windows), default=1)
        self.words = np.full((len(windows), self.width), -2, dtype=np.int32)
        for i, words in enumerate(windows):
            self.words[i, : len(words)] = [self.vocabulary.numbers[w.encode()] for w in words]
        self.length = np.array([len(w) for w in windows], dtype=np.int64)
        self.offset = offsets.astype(np.int64)
        prefix = [list(s) for s in frame["shingle"]]
        self.prefix, self.order, self.entry = {}, {}, {}
        for size, (numbers, entries) in _tables(self.vocabulary, prefix).items():
            code = _code(numbers)
            rank = np.argsort(code, kind="stable")
            self.prefix[size], self.order[size], self.entry[size] = numbers, (code[rank], rank), entries

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Mask of hit words, and the ids of the items hit."""
        ids = self.vocabulary.of(words)
        mask, items = np.zeros(len(ids), dtype=bool), set()
        padded = np.concatenate((ids, np.full(self.width, -3, dtype=np.int32)))
        steps = np.arange(self.width)
        for size, numbers in self.prefix.items():
            for position, entry in _rows_at(ids, {size: numbers}, self.order):
                window = self.entry[size][entry]
                begin = position - self.offset[window]
                fits = (begin >= 0) & (begin + self.length[window] <= len(ids))
                begin, window = begin[fits], window[fits]
                for low in range(0, len(begin), _SLICE):
                    b, w = begin[low : low + _SLICE], window[low : low + _SLICE]
                    wanted = self.words[w]
                    same = ((padded[b[:, None] + steps] == wanted) | (wanted == -2)).all(axis=1)
                    b, w = b[same], w[same]
                    for k in range(self.width):
                        mask[b[self.length[w] > k] + k] = True
                    for i in np.unique(w):
                        items.update(self.items[i])
        return mask, items


def _count_shingles(docs: DataFrame, text: str, blocks: list[str]) -> DataFrame:
    """``(shingle, n)``: occurrences in all documents, one partial row per task and shingle."""
    single = len(blocks) == 1

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in batches:
            words = [words_of(t) for t in frame["t"]]
            for path in blocks:
                block = last if single and last is not None else ShingleBlock(_load(path))
                for w in words:
                    block.add(w)
                if single:
                    last = block
                else:
                    yield pd.DataFrame(block.taken(), columns=["shingle", "n"])
        if last is not None:
            yield pd.DataFrame(last.taken(), columns=["shingle", "n"])

    partial = docs.select(F.col(f"`{text}`").cast("binary").alias("t")).mapInPandas(count, "shingle array<string>, n long")
    return partial.groupBy("shingle").agg(F.sum("n").alias("n"))


def prefix_windows(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(words, items, offset, shingle)``: distinct windows, the items that have them, and their rarest shingle."""
    windows = item_windows(items, item_key, item_text)
    shingles = _shingles(windows, SHINGLE)
    blocks = _write_blocks(shingles.select("shingle").distinct(), SHINGLE, "shingles")
    counts = _count_shingles(docs, text, blocks)
    ranked = shingles.join(counts, "shingle", "left").groupBy("words").agg(
        F.collect_set("item").alias("items"),
        F.min_by(F.struct("offset", "shingle"), F.struct(F.coalesce("n", F.lit(0)), "offset")).alias("p"),
    )
    return ranked.select("words", "items", "p.offset", "p.shingle")


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` (sorted array of item ids) and ``contaminated``."""
    blocks = _write_blocks(prefix_windows(docs, items, text, item_key, item_text), WINDOW, "windows")
    single = len(blocks) == 1

    @F.pandas_udf("struct<n_words: long, n_hit: long, items: array<string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept = WindowBlock(_load(blocks[0])) if single else None
        for texts in batches:
            words = [words_of(t) for t in texts]
            masks = [np.zeros(len(w), dtype=bool) for w in words]
            found: list[set[str]] = [set() for _ in words]
            for path in blocks:
                block = kept if single else WindowBlock(_load(path))
                for i, w in enumerate(words):
                    if w:
                        mask, ids = block.hits(w)
                        masks[i] |= mask
                        found[i] |= ids
            yield pd.DataFrame(
                {
                    "n_words": [len(w) for w in words],
                    "n_hit": [int(m.sum()) for m in masks],
                    "items": [sorted(f) for f in found],
                }
            )

    names = ("n_words", "n_hit", "items", "contaminated")
    # The row travels in a struct, so that no name of its own can clash.
    kept = [c for c in docs.columns if c.lower() not in names]
    scanned = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), scan(F.col(f"`{text}`").cast("binary")).alias("scan"))
    found = [F.col(f"scan.{n}").alias(n) for n in names[:3]]
    return scanned.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *found, (F.col("scan.n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents without any hit, with their own columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    scanned = decontaminate(packed.withColumn("_text", F.col(f"_row.`{text}`")), items, "_text")
    return scanned.filter(~F.col("contaminated")).select("_row.*")
