"""Alignment of the tokens of two tokenizers over the same texts, with the counts of aligned id pairs over all of them.

The byte offsets at which tokens of both sides end cut a text into groups; inside a group tokens are linked where their
bytes overlap. Most groups are one token on either side. For those an array made beforehand maps each id of the first
vocabulary to the id of the same bytes in the second, and such a group is counted in a vector as long as the first
vocabulary, one per task. Only links that the array doesn't give (irregular ones) become rows of id pairs, added up per
block of documents before they are shuffled.

Tokens are made once. A task writes per document its own distinct links with counts, in packed form, and per block the
distinct irregular pairs; a block is closed at ``BLOCK_LINKS`` links, so it fits in a task whatever the corpus. After
the pairs are counted over all blocks, each block gets the counts of its own pairs back, and its documents
are scored next to them: documents never become rows per link. Collected and sent to all tasks is one row per id of a vocabulary at most.

Texts are looked up word by word where that can't change the ids (see ``Lookup``); any other text is encoded whole.

Defined results: a null or empty text, and one whose joined token bytes differ from space + text on either side (such
as one holding U+2581), has no tokens: zeros and an empty ``groups_sha256``. Equal rows stay rows of their own. Columns other than
the id and the text aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import scratch_path

# Links of a block of documents at most, its last document aside.
BLOCK_LINKS = 1 << 20
_CACHED_WORDS = 300_000
_WIDE_SPACE = re.compile(r"\s\s|▁")
_MASK = (1 << 32) - 1

_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, regular binary, irregular binary, block long"
_WRITTEN = f"{_DOC}, in_vector boolean, pairs array<long>, counts array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Vocabularies:
    """Both tokenizers with the bytes of their ids, and the identity map from the first to the second."""

    def __init__(self, ranks_path: str, model_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._a = tiktoken.Encoding("alignment", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        self.bytes_b = [self._piece(i) for i in range(self._b.get_piece_size())]
        self.size_a, self.size_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # A whole piece goes before a single byte of the same value.
        same = {self.bytes_b[i]: i for i in sorted(range(len(self.bytes_b)), key=self._b.is_byte, reverse=True)}
        self.identity = np.array([same.get(token, -1) for token in self.bytes_a], dtype=np.int64)
        self.opens_word = np.array([token[:1] in (b" ", b"\n") for token in self.bytes_a])
        # What stands for an id inside a group and at the end of its side.
        self.shown = [f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"]

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        return self._a.encode_to_numpy(text, disallowed_special=())

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with the space that the model puts before it."""
        return self._b.encode(texts, num_threads=1)

    def fit(self, whole: str, a: Iterable[int], b: Iterable[int]) -> bool:
        want = whole.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want


class Alignment(NamedTuple):
    """Numbers of tokens and groups of a text, its groups, the ids of regular links, and irregular links as pairs."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    regular: np.ndarray
    irregular: np.ndarray


NOTHING = Alignment(0, 0, 0, "", np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))


def align_ids(v: Vocabularies, a: np.ndarray, b: np.ndarray) -> Alignment:
    """Ids of both sides over the same bytes, aligned."""
    ends_a, ends_b = np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])
    # The token of the other side that holds a token's last byte.
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    cut_a, cut_b = ends_b[over_a] == ends_a, ends_a[over_b] == ends_b
    alone_a, alone_b = cut_a.copy(), cut_b.copy()
    alone_a[1:] &= cut_a[:-1]
    alone_b[1:] &= cut_b[:-1]
    # Links begin and end where a token does, so there is one for each offset at which any token ends.
    at_a = a << 32 | b[over_a]
    regular = alone_a & alone_b[over_a] & (v.identity[a] == b[over_a])
    irregular = np.concatenate([at_a[~regular], (a[over_b] << 32 | b)[~cut_b]])
    # A group is written as its first side's ids and then the second's: a token's place counts those of earlier groups on the other side.
    before_a, before_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    until_a, until_b = np.flatnonzero(cut_a) + 1, np.concatenate(([0], np.flatnonzero(cut_b) + 1))
    shown = np.empty(len(a) + len(b), dtype=np.int64)
    shown[np.arange(len(a)) + until_b[before_a]] = 2 * a + cut_a
    shown[np.arange(len(b)) + until_a[before_b]] = 2 * (len(v.bytes_a) + b) + cut_b
    groups = "".join(map(v.shown.__getitem__, shown.tolist()))[:-1]
    return Alignment(len(a), len(b), int(cut_a.sum()), groups, a[regular], irregular)


class Lookup:
    """Ids of both sides of whole texts, with a bounded cache of words, each with the space or line break before it.

    The first tokenizer splits a text before each single space and around each single line break, and no piece of the
    second has a space anywhere but in front, or a line break at all. So where no two white-space characters touch, both
    end a token before each of the two, and the ids of a text are those of its words. New words are encoded in one go.
    """

    def __init__(self, vocabularies: Vocabularies):
        self.vocabularies = vocabularies
        self._words: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, words: list[str]) -> None:
        v = self.vocabularies
        whole = [w if w[:1] == "\n" else " " + w for w in words]
        a, b = v.encode_a("".join(whole)), v.encode_b(words)
        starts = np.flatnonzero(v.opens_word[a])
        # Before a line break the second tokenizer's space is a token of its own.
        b = [ids[1:] if w[:1] == "\n" else ids for ids, w in zip(b, words)]
        if len(starts) != len(words) or not v.fit("".join(whole), a, [i for ids in b for i in ids]):
            raise ValueError("words and tokens don't start together")
        raw, ends = a.astype("<u4").tobytes(), [*(starts[1:] * 4).tolist(), 4 * len(a)]
        at = 0
        for word, end, ids in zip(words, ends, b):
            self._words[word] = raw[at:end], np.array(ids, dtype="<u4").tobytes()
            at = end

    def _ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space + ``text`` on both sides; none where the text has no tokens."""
        v = self.vocabularies
        if text[0].isspace() or text[-1].isspace() or _WIDE_SPACE.search(text):
            a, (b,) = v.encode_a(" " + text), v.encode_b([text])
            if not v.fit(" " + text, a, b):
                return NOTHING.regular, NOTHING.regular
            return a.astype(np.int64), np.array(b, dtype=np.int64)
        words = text.replace("\n", " \n").split(" ")
        try:
            found = list(map(self._words.__getitem__, words))
        except KeyError:
            if len(self._words) > _CACHED_WORDS:
                self._words.clear()
            self._learn(list(set(words).difference(self._words)))
            found = list(map(self._words.__getitem__, words))
        a, b = zip(*found)
        return tuple(np.frombuffer(b"".join(x), dtype="<u4").astype(np.int64) for x in (a, b))

    def align(self, text: str | None) -> Alignment:
        if not text:
            return NOTHING
        a, b = self._ids(text)
        return align_ids(self.vocabularies, a, b) if len(a) else NOTHING


_loaded: dict[tuple[str, str], Lookup] = {}


def lookup(ranks_path: str, model_path: str) -> Lookup:
    key = (ranks_path, model_path)
    if key not in _loaded:
        _loaded[key] = Lookup(Vocabularies(*key))
    return _loaded[key]


def _packed(ids: np.ndarray, dtype: str) -> bytes:
    """Distinct values and how often each stands there, as counts behind values."""
    values, counts = np.unique(ids, return_counts=True)
    return values.astype(dtype).tobytes() + counts.astype("<u4").tobytes()


def _unpacked(packed: bytes, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // (np.dtype(dtype).itemsize + 4)
    return np.frombuffer(packed, dtype, n), np.frombuffer(packed, "<u4", n, len(packed) - 4 * n)


_NAMES = [c.split()[0] for c in _WRITTEN.split(", ")]
_ARROW = pa.schema(
    [("doc_id", pa.int64()), *((n, pa.int64()) for n in _NAMES[1:5]), ("groups_sha256", pa.string()), ("regular", pa.binary()), ("irregular", pa.binary())]
    + [("block", pa.int64()), ("in_vector", pa.bool_()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _tokens(docs: DataFrame, key: str, text: str, ranks_path: str, model_path: str) -> DataFrame:
    """Rows of documents, of blocks (``pairs`` without ``in_vector``) and of the vectors of tasks."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = lookup(ranks_path, model_path)
        identity = texts.vocabularies.identity
        vector = np.zeros(len(identity), dtype=np.int64)
        block = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        links: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        n_held = 0

        def pair_row(pairs: np.ndarray, counts: np.ndarray, in_vector: bool) -> tuple:
            return (*[None] * 8, block, in_vector, pairs, counts)

        def closed() -> pa.RecordBatch:
            """The rows of a block: its documents and its pairs; its regular links go into the vector."""
            nonlocal rows, links, ids, n_held, block
            if links:
                rows.append(pair_row(*np.unique(np.concatenate(links), return_counts=True), False))
                vector[:] += np.bincount(np.concatenate(ids), minlength=len(vector))
            out = _batch(rows)
            rows, links, ids, n_held, block = [], [], [], 0, block + 1
            return out

        for batch in batches:
            for doc, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                one = texts.align(whole)
                digest = hashlib.sha256(one.groups.encode()).hexdigest() if one.n_a else ""
                n_links = len(one.regular) + len(one.irregular)
                rows.append((doc, one.n_a, one.n_b, one.n_groups, n_links, digest, _packed(one.regular, "<u4"), _packed(one.irregular, "<u8"), block, None, None, None))
                links.append(one.irregular)
                ids.append(one.regular)
                n_held += n_links
                if n_held > BLOCK_LINKS:
                    yield closed()
        yield closed()
        seen = np.flatnonzero(vector)
        yield _batch([pair_row(seen << 32 | identity[seen], vector[seen], True)])

    chosen = docs.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t"))
    return chosen.mapInArrow(aligned, _WRITTEN)


def _paths(first: str | None, second: str | None) -> tuple[str, str]:
    import public_tokenizers

    return str(first or public_tokenizers.path("byte_bpe_50k.tiktoken")), str(second or public_tokenizers.path("piece_bpe_32k.model"))


def _pair_rows(written: DataFrame) -> DataFrame:
    rows = written.filter(F.col("in_vector").isNotNull())
    return rows.select("block", "in_vector", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(
        "block", "in_vector", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n")
    )


def _totals(written: DataFrame) -> DataFrame:
    """``pair``, ``total`` over all documents, and whether any task counted it in its vector; written once."""
    spark = written.sparkSession
    path = scratch_path(spark, "pair-totals")
    _pair_rows(written).groupBy("pair").agg(F.sum("n").alias("total"), F.max("in_vector").alias("regular")).write.parquet(path)
    return spark.read.parquet(path)


def _best(totals: DataFrame) -> DataFrame:
    """The highest count of each id of the second vocabulary, one row each."""
    return totals.groupBy(F.col("pair").bitwiseAND(_MASK).alias("b")).agg(F.max("total").alias("best"))


def pair_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """``a``, ``b``, ``n``, ``best``: how many links hold the two ids, and whether none of ``b`` has more."""
    path = scratch_path(docs.sparkSession, "alignment")
    _tokens(docs, key, text, *_paths(first, second)).write.parquet(path)
    totals = _totals(docs.sparkSession.read.parquet(path))
    rows = totals.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(_MASK).alias("b"), F.col("total").alias("n"))
    return rows.join(_best(totals), "b").select("a", "b", "n", (F.col("n") == F.col("best")).alias("best"))


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", first: str | None = None, second: str | None = None) -> DataFrame:
    """One row per row of ``docs``: numbers of tokens, groups and links, links that are their second id's best, the sum of counts over links, and a digest of the groups.

    ``first`` is the path of a byte-level vocabulary as ranks, ``second`` that of a sentence-piece model.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "alignment")
    _tokens(docs, key, text, *_paths(first, second)).write.parquet(path)
    written = spark.read.parquet(path)
    totals = _totals(written)
    # One row per id of a vocabulary at most, whatever the corpus.
    best = F.broadcast(_best(totals))
    scored = totals.join(best, F.col("pair").bitwiseAND(_MASK) == F.col("b")).select("pair", "total", "regular", (F.col("total") == F.col("best")).alias("is_best"))
    known = scored.filter("regular").select(F.shiftright("pair", 32).alias("a"), "total", "is_best").toPandas()
    size = int(known["a"].max()) + 1 if len(known) else 1
    count_of, best_of = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=bool)
    count_of[known["a"]], best_of[known["a"]] = known["total"], known["is_best"]

    def score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pair"].to_numpy())
        pair, total, is_best = (pairs[n].to_numpy()[order] for n in ("pair", "total", "is_best"))
        n_best, count_sum = [], []
        for regular, irregular in zip(docs["regular"].to_pylist(), docs["irregular"].to_pylist()):
            ids, n = _unpacked(regular, "<u4")
            links, m = _unpacked(irregular, "<u8")
            at = np.searchsorted(pair, links.astype(np.int64))
            n_best.append(int(n[best_of[ids]].sum(dtype=np.int64) + m[is_best[at]].sum(dtype=np.int64)))
            count_sum.append(int((count_of[ids] * n).sum() + (total[at] * m).sum()))
        kept = {n: docs[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table({**kept, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64()), "groups_sha256": docs["groups_sha256"]})

    own = _pair_rows(written).filter(~F.col("in_vector")).select(F.col("block").alias("own"), "pair").join(scored, "pair")
    rows = written.filter(F.col("in_vector").isNull()).select(*(c.split()[0] for c in _DOC.split(", ")))
    return rows.groupBy("block").cogroup(own.select("own", "pair", "total", "is_best").groupBy("own")).applyInArrow(score, RESULT)
