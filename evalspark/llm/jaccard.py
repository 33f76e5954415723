"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets with similarity of at least 3/4 differ in at most D = (|r| + |s|) / 7 elements. Hash the universe into m > D
segments; by the pigeonhole principle at least m - D segments hold the same subset in both sets. Sizes fall into
bands that grow by half, each with a number of segments of its own; a set takes part in its own band and, where a
larger partner may lie there, in the next.

*Sets without partners.* At least three quarters of a linked set's shingles stand in its partner. Half of the universe is
counted first; a set with more than a quarter of its shingles to itself there is linked with nothing and not indexed.

*Index of segment subsets, allotted by cost.* Every non-empty segment gives one signature, which costs what its list is long. Of
m signatures a set needs its D + 1 cheapest: in one order of all signatures the first D + 1 of each of two partners have one in
common. So the longest lists lose all members that can do without them, and no link is lost.

*Exact verification.* In each list every member is first compared with the one that has the most company. Lists whose members then fall into one
component are used up, so a group of copies costs its size and not its square. In the others, members of different
components are tried by sketches of parities inside the task that holds the list; only possible pairs become rows, and those are compared by
whole sets.

Sets are told apart, and shingles compared, by 64-bit hashes. Equal texts share one set from the start.

*Joins.* Every table here grows with the input, so none is broadcast: Spark takes a table of sets, whose size it estimates from a
few of its bytes, for a small one and would gather it in the driver. All joins exchange both sides (``_merged``).

Defined results: a null text, or one without words, has no shingles and is linked with nothing. Repeated rows share a
component. Rows without an id are compared like others; a component of such rows alone has no id. Other columns are not
touched. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.components import components
from evalspark.llm.shingles import mix, set_digest, shingle_set
from evalspark.session import ensure_checkpoint_dir, remove_path, scratch_path

# Lists of more members count as equally long.
LIST = 4096
_BAND_BITS = np.uint64(63)
_BITMAP = 1 << 24
_BUCKET_BITS = 11
_BLOCK = 1 << 19
_ROWS = 1000
_FINE = 8
_MEASURED_SCHEMA = (
    "row_id long, text_key long, node long, n long, place long, sampled long, bucket int, base long, hashes binary, places binary"
)


def _merged(table: DataFrame) -> DataFrame:
    """A side of a join that must not pass through the driver, however small Spark takes it to be."""
    return table.hint("merge")


def band_limits(limit: int = 1 << 33) -> np.ndarray:
    """First sizes of the bands: 1, 2, 3, 4, 6, 9, 13, ..."""
    out = [1]
    while out[-1] < limit:
        out.append(max(out[-1] + 1, out[-1] * 3 // 2))
    return np.array(out, dtype=np.int64)


LIMITS = band_limits()


def _most(band: int) -> int:
    """The largest number of differences of any linked pair whose larger set lies in ``band``."""
    return 2 * (int(LIMITS[band + 1]) - 1) // 7


def segments(band: int, deletions: bool) -> int:
    """Segments of a band: enough for the pigeonhole, and a reserve for those that stay empty or meet long lists."""
    need = _most(band) + 1
    if deletions:
        need = -(-need // 2)
        return need + need // 8
    return need + need // 16 + isqrt(need)


def differences(size: int, band: int) -> int:
    """The largest number of differences of a set of ``size`` and a partner, the larger of them in ``band``."""
    return (size + min(4 * size // 3, int(LIMITS[band + 1]) - 1)) // 7


def bands_of(size: int) -> list[int]:
    own = int(np.searchsorted(LIMITS, size, side="right")) - 1
    return [own, own + 1] if 4 * size // 3 >= LIMITS[own + 1] else [own]


def _signed(values: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Signatures of a set's segments, and how many of them it can do without.

    A set and its partner agree in all but D of m segments. In one order of all signatures, the first D + 1 of each have
    one in common. Empty segments come last in it; a set that needs some of them takes those with the smallest numbers.
    """
    segment = (mix(values + np.uint64(2 * band + 1)) % np.uint64(segments(band, False))).astype(np.int64)
    sums = np.zeros(segments(band, False), dtype=np.uint64)
    np.add.at(sums, segment, mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    filled = np.bincount(segment, minlength=len(sums)) > 0
    spare = int(filled.sum()) - differences(len(values), band) - 1
    taken = np.flatnonzero(filled)
    if spare < 0:
        taken = np.concatenate((taken, np.flatnonzero(~filled)[:-spare]))
    named = mix(sums[taken] + mix(taken.astype(np.uint64) + np.uint64(band << 40)))
    return (named & ~_BAND_BITS) | np.uint64(band), max(spare, 0)


def _measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of documents, and rows of blocks: half of the shingles of many sets, by buckets of their hashes.

    Documents ``(row_id, text_key, node, n, place, sampled)``; ``place`` numbers the sets of blocks, of which copies in one
    block have none. Blocks ``(bucket, base, hashes, places)``: 32 bits of each hash, and its set's place less ``base``.
    """

    def block(base: int, held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.concatenate(held)
        places = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
        order = np.argsort(values)
        values, places = values[order], places[order]
        bucket = (values >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)
        hashes = (values >> np.uint64(32 - _BUCKET_BITS)).astype(np.uint32)
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(values) else np.empty(0, dtype=np.int64)
        end = np.append(begin[1:], len(values))
        rows = len(begin)
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(begin, end)], pa.binary()) for x in (hashes, places)]
        blank = [pa.nulls(rows, f.type) for f in schema][:6]
        return pa.RecordBatch.from_arrays([*blank, pa.array(bucket[begin]), pa.array(np.full(rows, base)), *packed], schema=schema)

    schema = pa.schema(
        [(c, pa.int64()) for c in ("row_id", "text_key", "node", "n", "place", "sampled")]
        + [("bucket", pa.int32()), ("base", pa.int64()), ("hashes", pa.binary()), ("places", pa.binary())]
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, seen, count = TaskContext.get().partitionId() << 40, [], set(), 0
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            rows = []
            for whole in batch.column(2).to_pylist():
                values = shingle_set(whole)
                node = int(np.uint64(set_digest(values)).astype(np.int64)) if len(values) else None
                if node is None or node in seen:
                    rows.append((node, len(values), None, None))
                    continue
                sample = values[(values & np.uint64(1)) == 0]
                rows.append((node, len(values), base + len(held), len(sample)))
                seen.add(node)
                held.append(sample)
                count += len(sample)
                if len(held) == 1 << 16 or count >= _BLOCK:
                    yield block(base, held)
                    base, held, seen, count = base + len(held), [], set(), 0
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            blank = [pa.nulls(len(rows), f.type) for f in schema][6:]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *blank], schema=schema)
        if held:
            yield block(base, held)

    whole = F.col(f"`{text}`")
    return docs.select(
        F.col(f"`{key}`").cast("long").alias("row_id"), F.xxhash64(whole).alias("text_key"), whole.cast("binary").alias("t")
    ).mapInArrow(measure, _MEASURED_SCHEMA)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket in; one row ``(place)`` for each shingle of a set that stands in another one as well."""

    def shared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        size = [len(r[2]) // 4 for r in rows]
        bucket = np.repeat(np.array([r[0] for r in rows], dtype=np.uint64), size)
        value = (bucket << np.uint64(32)) | np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint32)
        place = np.repeat(np.array([r[1] for r in rows], dtype=np.int64), size) + np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint16)
        order = np.argsort(value)
        value = value[order]
        same = value[1:] == value[:-1]
        often = np.concatenate((same, [False])) | np.concatenate(([False], same))
        yield pa.RecordBatch.from_arrays([pa.array(place[order[often]])], names=["place"])

    held, count = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            # Buckets stay whole.
            if count >= _BLOCK and row[0] != held[-1][0]:
                yield from shared(held)
                held, count = [], 0
            held.append(row)
            count += len(row[2]) // 4
    if held:
        yield from shared(held)


def _candidates(measured: DataFrame) -> DataFrame:
    """``(node, text_key)`` of the sets that may have a partner, with one of their texts.

    A linked set has at most a quarter of its shingles to itself. Whoever has more of them in the sampled half of the
    universe alone is linked with nothing.
    """
    blocks = measured.filter("bucket IS NOT NULL").select("bucket", "base", "hashes", "places")
    hits = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_hits, "place long")
    hits = hits.groupBy("place").agg(F.count(F.lit(1)).alias("hits"))
    sets = measured.filter("place IS NOT NULL").select("place", "node", "n", "sampled", "text_key")
    own = F.col("sampled") - F.coalesce("hits", F.lit(0))
    return sets.join(_merged(hits), "place", "left").filter(4 * own <= F.col("n")).groupBy("node").agg(F.min("text_key").alias("text_key"))


def _index(sets: DataFrame) -> DataFrame:
    """``(sig, node, spare)``: the signatures of all sets, in each of their bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                named, nodes, spares = [], [], []
                part = batch.slice(at, 500)
                for node, elements in zip(part.column(0).to_pylist(), part.column(1)):
                    values = elements.values.to_numpy().view(np.uint64)
                    for band in bands_of(len(values)):
                        signatures, spare = _signed(values, band)
                        named.append(signatures.view(np.int64))
                        nodes.append(np.full(len(signatures), node))
                        spares.append(np.full(len(signatures), spare, dtype=np.int32))
                if named:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (named, nodes, spares)], names=["sig", "node", "spare"])

    return sets.select("node", "elements").mapInArrow(sign, "sig long, node long, spare int")


def _shared(signatures: DataFrame) -> DataFrame:
    """``(sig, node, spare, held)``: signatures of two sets or more, and how many hold them (``LIST`` if more)."""
    limit = LIST

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int32)]
        long = None  # the list last reported as a long one may go on

        def closed(rows: list[np.ndarray], size: np.ndarray) -> pa.RecordBatch:
            size = size.copy()
            if long is not None and rows[0][0] == long:
                size[0] = limit
            held = np.repeat(np.minimum(size, limit), np.diff(np.append(np.flatnonzero(_first(rows[0])), len(rows[0]))))
            chosen = held > 1
            return pa.RecordBatch.from_arrays([*(pa.array(r[chosen]) for r in rows), pa.array(held[chosen])], names=["sig", "node", "spare", "held"])

        for batch in batches:
            rows = [np.concatenate((old, batch.column(i).to_numpy())) for i, old in enumerate(rest)]
            if not len(rows[0]):
                continue
            begin = np.flatnonzero(_first(rows[0]))
            size = np.diff(np.append(begin, len(rows[0])))
            last = int(rows[0][-1])
            if size[-1] >= limit or last == long:
                yield closed(rows, size)
                long, rest = last, [r[:0] for r in rows]
                continue
            if len(begin) > 1:
                yield closed([r[: begin[-1]] for r in rows], size[:-1])
            rest = [r[begin[-1] :] for r in rows]
        if len(rest[0]):
            yield closed(rest, np.array([len(rest[0])]))

    return signatures.repartition("sig").sortWithinPartitions("sig").mapInArrow(shared, "sig long, node long, spare int, held long")


def _first(sig: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], sig[1:] != sig[:-1]))


def _allotted(shared: DataFrame) -> DataFrame:
    """``(sig, node, weight)``: each set on its shortest lists, without as many of the longest as it can spare.

    The weight, the sum of its lists' lengths, is large for a set in the midst of similar ones.
    """
    own = Window.partitionBy("node", _band())
    rank = F.row_number().over(own.orderBy(F.desc("held"), F.desc("sig")))
    weight = F.sum("held").over(own)
    return shared.select("sig", "node", "spare", rank.alias("rank"), weight.alias("weight")).filter("rank > spare").select("sig", "node", "weight")


def _hub_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists in, each with its heaviest member first; that member with each other."""
    sig, hub = None, None
    for batch in batches:
        sigs, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sigs):
            continue
        first = _first(sigs)
        hubs = nodes[first]
        if sigs[0] == sig:
            hubs[0] = hub
        every = hubs[np.cumsum(first) - 1]
        sig, hub = sigs[-1], hubs[-1]
        pairs = np.unique(np.stack((every, nodes), axis=1)[every != nodes], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def parity_sketch(values: np.ndarray, scale: int = 1) -> np.ndarray:
    """For each of many segments whether it has an odd number of elements, as longs.

    An element in one of two sets only turns one bit, so two sketches never differ in more bits than their sets differ
    in elements. There are at least ``scale`` times as many bits as elements, up to 131,072; a sketch folds to one of half its length.
    """
    bits = 1 << min(17, max(8, (scale * len(values) - 1).bit_length()))
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _folded_all(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of different lengths, folded to one."""
    if all(len(s) == 8 * width for s in sketches):
        return np.frombuffer(b"".join(sketches), dtype=np.uint64).reshape(-1, width)
    return np.concatenate([_folded(np.frombuffer(s, dtype=np.uint64).reshape(1, -1), width) for s in sketches])


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that holds every key; some others pass as well."""
    slot = F.pmod(F.col("text_key"), F.lit(_BITMAP))
    words = keys.groupBy(F.shiftright(slot, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))).alias("bits")
    )
    out = np.zeros(_BITMAP >> 6, dtype=np.int64)
    found = words.select(F.col("w").cast("long").alias("w"), "bits").toArrow()
    out[found["w"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _fetch_sets(docs: DataFrame, text: str, chosen: DataFrame) -> DataFrame:
    """``(node, n, sketch, elements)`` for the sets of ``chosen(node, text_key)``, written once. One text per set is read again.

    The bitmap of those texts keeps most others from being cut into shingles; the join leaves out the rest.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(chosen))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS)):
            slot = batch.column(0).to_numpy() % _BITMAP
            taken = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            found, sketches = {}, []
            for whole in batch.column(1).take(pa.array(taken)).to_pylist():
                values = shingle_set(whole)
                node = int(np.uint64(set_digest(values)).astype(np.int64))
                if len(values) and node not in found:
                    found[node] = values.view(np.int64)
                    sketches.append(parity_sketch(values).tobytes())
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.keys(), pa.int64()),
                        pa.array([len(v) for v in found.values()], pa.int64()),
                        pa.array(sketches, pa.binary()),
                        pa.array(found.values(), pa.list_(pa.int64())),
                    ],
                    names=["node", "n", "sketch", "elements"],
                )

    whole = F.col(f"`{text}`")
    texts = docs.select(F.xxhash64(whole).alias("text_key"), whole.cast("binary").alias("t"))
    sets = texts.mapInArrow(fetch, "node long, n long, sketch binary, elements array<long>")
    path = scratch_path(spark, "sets")
    sets.join(_merged(chosen), "node", "left_semi").dropDuplicates(["node"]).write.parquet(path)
    return spark.read.parquet(path)


def _near(na: np.ndarray, nb: np.ndarray, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Whether sizes and sketches leave it possible that two sets are linked."""
    turned = np.bitwise_count(sa ^ sb).sum(axis=1, dtype=np.int64)
    return (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)) & (7 * turned <= na + nb)


def _possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sizes and sketches leave possible; they leave out only pairs that aren't linked."""
    b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            sa, sb = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            width = np.minimum([len(s) for s in sa], [len(s) for s in sb])
            chosen = np.zeros(len(na), dtype=bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                one, other = (_folded_all([s[i] for i in at], w // 8) for s in (sa, sb))
                chosen[at] = _near(na[at], nb[at], one, other)
            taken = pa.array(chosen)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(taken), batch.column("b").filter(taken)], names=["a", "b"])

    return pairs.join(_merged(b), "b").join(_merged(a), "a").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(near, "a long, b long")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets have a similarity of 3/4 or more."""
    right = sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    left = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea"))
    common = F.size(F.array_intersect("ea", "eb"))
    union = F.size("ea") + F.size("eb") - common
    return pairs.join(_merged(right), "b").join(_merged(left), "a").filter(100 * common >= 75 * union).select("a", "b")


def _mixed(allotted: DataFrame, labels: DataFrame) -> DataFrame:
    """``(sig, node, label)`` of the lists that several components share; of lists with equal members one."""
    named = allotted.select("sig", "node").join(_merged(labels), "node", "left").select("sig", "node", F.coalesce("component", "node").alias("label"))
    mixed = (
        named.groupBy("sig")
        .agg(
            F.min("label").alias("least"),
            F.max("label").alias("most"),
            F.count(F.lit(1)).alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        .filter("least != most")
        .groupBy("x", "y", "size")
        .agg(F.min("sig").alias("sig"))
    )
    return named.join(_merged(mixed.select("sig")), "sig", "left_semi")


def _pairs_in_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(sig, label, node, n, sketch)`` sorted by list in; the pairs of different labels that sizes and sketches leave possible out."""

    def tried(a: np.ndarray, b: np.ndarray, label: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        apart = (label[a] != label[b]) & (4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b]))
        a, b = a[apart], b[apart]
        near = _near(n[a], n[b], sketch[a], sketch[b])
        a, b = node[a[near]], node[b[near]]
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def possible(sig: np.ndarray, label: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: list[bytes]) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(_first(sig))
        size = np.diff(np.append(begin, len(sig)))
        band = sig[begin] & int(_BAND_BITS)
        for members, of in {(s, b) for s, b in zip(size.tolist(), band.tolist()) if s > 1}:
            rows = (begin[(size == members) & (band == of)][:, None] + np.arange(members)).ravel()
            sketches = [sketch[i] for i in rows]
            columns = label[rows], node[rows], n[rows], _folded_all(sketches, min(map(len, sketches)) // 8)
            # About 8 MB of sketches at once: pairs of many short lists, or some rows of a long one with those behind them.
            most = (1 << 20) // columns[-1].shape[1]
            if members <= 256:
                one, other = np.triu_indices(members, 1)
                starts, step = np.arange(0, len(rows), members)[:, None], max(1, most // len(one))
                for at in range(0, len(starts), step):
                    yield tried((starts[at : at + step] + one).ravel(), (starts[at : at + step] + other).ravel(), *columns)
                continue
            for start in range(0, len(rows), members):
                at = 0
                while at < members - 1:
                    step = min(max(1, most // (members - at)), members - 1 - at)
                    one, other = np.triu_indices(step, 1, members - at)
                    yield tried(start + at + one, start + at + other, *columns)
                    at += step

    held: list = [np.empty(0, dtype=np.int64)] * 4 + [[]]
    for batch in batches:
        new = [*(batch.column(i).to_numpy() for i in range(4)), batch.column(4).to_pylist()]
        # The last list may go on in the next batch.
        rows = [np.concatenate((old, x)) for old, x in zip(held[:4], new)] + [held[4] + new[4]]
        last = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        held = [x[last:] for x in rows]
        if last:
            yield from possible(*(x[:last] for x in rows))
    if len(held[0]):
        yield from possible(*held)


def _across(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of one list and different labels that sizes and sketches leave possible.

    A pair may stand in many lists, so the sketches are fine ones: they leave out pairs that come less close than 0.73 or so.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                fine = [parity_sketch(e.values.to_numpy().view(np.uint64), _FINE).tobytes() for e in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fine, pa.binary())], names=["node", "n", "sketch"])

    fine = sets.select("node", "n", "elements").mapInArrow(sketch, "node long, n long, sketch binary")
    members = mixed.join(_merged(fine), "node").select("sig", "label", "node", "n", "sketch")
    return members.repartition("sig").sortWithinPartitions("sig").mapInArrow(_pairs_in_lists, "a long, b long").distinct()


class _Links:
    """The components that the verified links so far make."""

    def __init__(self, spark):
        self.labels = spark.createDataFrame([], "node long, component long")

    def add(self, found: DataFrame) -> None:
        found = found.checkpoint()
        if not found.isEmpty():
            # Components of components: the old ones enter as their stars.
            stars = self.labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            self.labels = components(stars.union(found)).checkpoint()


def _band() -> Column:
    return F.col("sig").bitwiseAND(F.lit(int(_BAND_BITS))).cast("int")


def similar(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(row_id, text_key, n, label, component_id)`` per row of ``docs``; equal labels are linked."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path, narrow, lists = (scratch_path(spark, label) for label in ("measured", "rows", "lists"))
    _measured(docs, key, text).write.parquet(path)
    measured = spark.read.parquet(path)
    measured.filter("bucket IS NULL").select("row_id", "text_key", "node", "n").write.parquet(narrow)
    rows = spark.read.parquet(narrow)
    chosen = _candidates(measured).checkpoint()
    # Blocks are used up; what goes on is narrow.
    remove_path(spark, path)
    sets = _fetch_sets(docs, text, chosen)
    _allotted(_shared(_index(sets))).write.parquet(lists)
    allotted = spark.read.parquet(lists)

    state = _Links(spark)
    by_list = allotted.repartition("sig").sortWithinPartitions("sig", F.desc("weight"), "node")
    state.add(_linked(_possible(by_list.mapInArrow(_hub_pairs, "a long, b long").distinct(), sets), sets))
    # A list inside one component hides no link.
    state.add(_linked(_across(_mixed(allotted, state.labels), sets), sets))
    remove_path(spark, lists)

    named = rows.join(_merged(state.labels), "node", "left").select(
        "row_id", "text_key", "n", F.coalesce("component", "node").alias("label")
    )
    smallest = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("row_id").alias("smallest"))
    return named.join(_merged(smallest), "label", "left").select(
        "row_id", "text_key", "n", "label", F.when(F.col("label").isNull(), F.col("row_id")).otherwise(F.col("smallest")).alias("component_id")
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first row of each component, with its own columns; rows without words stay, as they are linked with nothing.

    The first row has the smallest id (rows without an id come last), then the smallest text hash. Of rows equal in both
    one stays.
    """
    rows = similar(docs, key, text).filter("label IS NOT NULL")
    order = F.struct(F.col("row_id").isNull(), "row_id", "text_key")
    first = rows.groupBy("label").agg(F.min_by(F.struct("row_id", "text_key"), order).alias("first")).select("first.*")
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(f"`{key}`").cast("long").alias("_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("_key"),
        F.coalesce(F.col(f"`{text}`").rlike(r"[^ \t-\r]"), F.lit(False)).alias("_words"),
    )
    same = F.col("_id").eqNullSafe(F.col("row_id")) & (F.col("_key") == F.col("text_key"))
    chosen = packed.filter("_words").join(_merged(first), same, "left_semi")
    one = chosen.dropDuplicates(["_id", "_key"])
    return one.select("_row.*").unionByName(packed.filter(~F.col("_words")).select("_row.*"))
