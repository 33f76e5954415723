"""Blocking keys that bring a text and any slightly longer text containing it together, and what stands beside a block.

Take a text ``s`` and a longer text ``t`` that contains it at offset ``o``, with ``len(s) > 0.8 * len(t)``.
Lengths fall into classes ``g`` growing by a quarter. Within the first ``w = g/8`` positions of ``s`` the
position with the smallest hash of its next characters is the anchor, and the key is the hash of the block
that starts there (seven eighths of ``g`` long). Seen from ``t`` the same positions are the window
``[o, o + w)``, with the same smallest hash. So ``t`` lists the anchors of the windows at every offset that
a contained text could have; consecutive windows mostly share their anchor, hence about ten keys per text
whatever its length, and no contained pair is ever missed. Equal keys only propose; callers verify.

Many texts may share a block (one body with different heads and tails). So a contained text also names hashes of what it has on
either side of the block, over lengths rounded down to a multiple of a *grain* that is the root of the longest side. A
container gives the hashes of its own sides at all those multiples, a root's worth each, and matches a contained text
only where both sides agree. What is left are the lengths within one grain, however many texts share the block; each is
tried against the hash of the whole contained text, at the cost of one subtraction (``span_rows``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POSITION_BITS = 28
_GRAM = 12


def size_classes(limit: int) -> list[int]:
    """1, 2, 3, ... growing by a quarter once that exceeds one."""
    sizes = [1]
    while sizes[-1] < limit:
        sizes.append(max(sizes[-1] + 1, sizes[-1] * 5 // 4))
    return sizes


_CLASSES = np.array(size_classes(1 << 30), dtype=np.int64)


def class_of(length: int) -> int:
    """Largest class size not above ``length``."""
    return int(_CLASSES[np.searchsorted(_CLASSES, length, side="right") - 1])


_power_cache: dict[int, np.ndarray] = {}


def _powers(base: int, count: int) -> np.ndarray:
    """The first ``count`` powers modulo 2**64; grown as needed and kept per worker."""
    known = _power_cache.get(base)
    if known is None or len(known) < count:
        values = np.full(max(count, 4096), base, dtype=np.uint64)
        values[0] = 1
        known = _power_cache[base] = np.cumprod(values, dtype=np.uint64)
    return known[:count]


def _mix(values: np.ndarray) -> np.ndarray:
    mixed = values ^ (values >> np.uint64(32))
    mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


class RollingHash:
    """Hashes of all substrings of one text from prefix sums modulo 2**64."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = len(codes)
        if self.length >= 1 << _POSITION_BITS:
            raise ValueError(f"texts of {1 << _POSITION_BITS} characters or more have to be cut first")
        self.sums = np.zeros(self.length + 1, dtype=np.uint64)
        np.cumsum(codes * _powers(_BASE, self.length), dtype=np.uint64, out=self.sums[1:])
        self.inverse = _powers(_INVERSE, self.length)

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        return _mix((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])

    def spans(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Hashes of substrings of different sizes."""
        return _mix((self.sums[starts + sizes] - self.sums[starts]) * self.inverse[np.minimum(starts, self.length - 1)])

    def all_of(self, size: int, count: int) -> np.ndarray:
        """Hashes of the substrings of ``size`` starting at 0 .. count-1."""
        return _mix((self.sums[size : size + count] - self.sums[:count]) * self.inverse[:count])


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values, by running minima inside blocks of that width."""
    if width == 1:
        return values
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def _widths(size_class: int) -> tuple[int, int]:
    """The anchor window of a class, and the length of its blocks."""
    width = max(1, size_class // 8)
    return width, size_class - width + 1


def grains(size_class: int) -> tuple[int, int]:
    """The grain of the left and of the right side of a block: roots of the longest that can be."""
    return max(1, math.isqrt(size_class // 8)), max(1, math.isqrt(size_class * 3 // 8))


def _anchors(hashes: RollingHash, size_class: int, offsets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchor positions of the windows at offsets 0 .. offsets-1, with their block keys."""
    width, block = _widths(size_class)
    order = hashes.all_of(min(_GRAM, block), offsets + width - 1)
    # The position in the low bits makes the leftmost of equal hashes the smallest.
    mask = np.uint64((1 << _POSITION_BITS) - 1)
    ranked = (order & ~mask) | np.arange(len(order), dtype=np.uint64)
    positions = np.unique(window_minima(ranked, width) & mask).astype(np.int64)
    return positions, hashes.of(positions, block).view(np.int64)


class Block(NamedTuple):
    """A block of a text in one of its roles."""

    contained: bool
    size_class: int
    block_key: int
    pos: int


def text_blocks(hashes: RollingHash) -> list[Block]:
    """The blocks of one text, first as a contained text, then as a container."""
    length = hashes.length
    own = class_of(length)
    (pos,), (key,) = (x.tolist() for x in _anchors(hashes, own, 1))
    blocks = [Block(True, own, key, pos)]
    shortest, longest = length * 4 // 5 + 1, length - 1
    if shortest <= longest:
        first = np.searchsorted(_CLASSES, shortest, side="right") - 1
        last = np.searchsorted(_CLASSES, longest, side="right") - 1
        for size_class in _CLASSES[first : last + 1].tolist():
            offsets = length - max(size_class, shortest) + 1
            for pos, key in zip(*(x.tolist() for x in _anchors(hashes, size_class, offsets))):
                blocks.append(Block(False, size_class, key, pos))
    return blocks


def _side_lengths(block: Block, length: int) -> tuple[tuple[int, int], tuple[int, int]]:
    """The least and the most that can stand left and right of a block of a text of that length."""
    width, size = _widths(block.size_class)
    right = length - block.pos - size
    if block.contained:
        return (block.pos, block.pos), (right, right)
    # What the block and the longest other side leave of the shortest contained text.
    shortest, most_left = length * 4 // 5 + 1, min(block.pos, width - 1)
    return (max(0, shortest - size - right), most_left), (max(0, shortest - size - most_left), right)


class Anchor(NamedTuple):
    """A block and what stands beside it. ``lefts[i]`` is the hash of the ``(left_first + i) * grain`` characters before
    the block, ``rights`` likewise after it; a contained text has one of each. ``whole`` is the hash of the text."""

    contained: bool
    size_class: int
    block_key: int
    pos: int
    whole: int
    left_first: int
    lefts: np.ndarray
    right_first: int
    rights: np.ndarray


def anchors(hashes: RollingHash, blocks: list[Block]) -> list[Anchor]:
    """The blocks of one text with their sides; all of them are hashed at once."""
    firsts, starts, sizes = [], [], []
    for block in blocks:
        left, right = _side_lengths(block, hashes.length)
        left_grain, right_grain = grains(block.size_class)
        left_first, right_first = left[0] // left_grain, right[0] // right_grain
        lefts = np.arange(left_first * left_grain, left[1] + 1, left_grain)
        rights = np.arange(right_first * right_grain, right[1] + 1, right_grain)
        firsts.append((left_first, right_first))
        starts += [block.pos - lefts, np.full(len(rights), block.pos + _widths(block.size_class)[1])]
        sizes += [lefts, rights]
    found = hashes.spans(np.concatenate(starts), np.concatenate(sizes)).view(np.int64)
    whole = hashes.all_of(hashes.length, 1).view(np.int64).item()
    out, at = [], 0
    for i, (block, (left_first, right_first)) in enumerate(zip(blocks, firsts)):
        middle = at + len(sizes[2 * i])
        end = middle + len(sizes[2 * i + 1])
        out.append(Anchor(*block, whole, left_first, found[at:middle], right_first, found[middle:end]))
        at = end
    return out


def text_keys(text: str) -> list[Anchor]:
    """The anchors of one text, first as a contained text, then as a container."""
    hashes = RollingHash(text)
    return anchors(hashes, text_blocks(hashes))


# Bodies for ``operators/placed``: a text, its number and what is known of it, to rows of the schema above them.

_BLOCK_FIELDS = [("size_class", pa.int32()), ("block_key", pa.int64()), ("pos", pa.int32()), ("len", pa.int32())]
KEYS = pa.schema(
    [("row", pa.int64()), ("contained", pa.bool_()), *_BLOCK_FIELDS, ("whole", pa.int64())]
    + [("left_at", pa.int32()), ("left_hash", pa.int64()), ("right_at", pa.int32()), ("right_hash", pa.int64())]
)


def key_rows(row: int, order: int | None, text: str | None, _: list[dict]) -> Iterator[tuple]:
    """The blocks of a text, with sides only where it is the contained text; one without a number is no container."""
    if not text:
        return
    hashes = RollingHash(text)
    blocks = text_blocks(hashes)
    (own,) = anchors(hashes, blocks[:1])
    yield (row, *own[:4], len(text), own.whole, own.left_first, own.lefts[0].item(), own.right_first, own.rights[0].item())
    if order is not None:
        for block in blocks[1:]:
            yield (row, *block, len(text), None, None, None, None, None)


SIDES = pa.schema(
    [("row", pa.int64()), *_BLOCK_FIELDS]
    + [("left_first", pa.int32()), ("lefts", pa.list_(pa.int64())), ("right_first", pa.int32()), ("rights", pa.list_(pa.int64()))]
)


def side_rows(row: int, order: int, text: str, wanted: list[dict]) -> Iterator[tuple]:
    """Container blocks of a text, named by (size_class, block_key, pos), with their sides."""
    blocks = [Block(False, w["size_class"], w["block_key"], w["pos"]) for w in wanted]
    for a in anchors(RollingHash(text), blocks):
        yield (row, *a[1:4], len(text), *a[5:])


SPANS = pa.schema([("ord", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())])


def span_rows(row: int, order: int, text: str, wanted: list[dict]) -> Iterator[tuple]:
    """Spans of a text by (start, size, whole) with their SHA-256; those without the hash ``whole``, where one is given, are left out."""
    hashes = RollingHash(text)
    spans = sorted({(w["start"], w["size"], w["whole"]) for w in wanted}, key=lambda s: s[:2])
    starts, sizes = (np.array(x, dtype=np.int64) for x in list(zip(*spans))[:2])
    for (start, size, whole), have in zip(spans, hashes.spans(starts, sizes).view(np.int64).tolist()):
        if whole is None or whole == have:
            yield order, start, size, hashlib.sha256(text[start : start + size].encode()).digest()
