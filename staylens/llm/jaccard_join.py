"""Exact Jaccard similarity join of shingle sets through count vectors (operator 9).

The shingles of a document are hashed into groups, and the numbers of shingles
per group are its point. Two sets share at most the sum of the smaller
coordinates, so most pairs are refused by their points alone; the others are
verified on the sets.

Points meet in two steps. Two documents at the threshold differ in at most D
shingles, D following from their sizes. Within a band of sizes, shingles are dealt
to more than D chunks of groups, so at least one chunk must agree in full: the
chunk's content is the key under which documents meet. Documents under one key
are first compared with one pivot; where that leaves several components, an
R-tree over the points of the key's documents finds the other pairs whose summed
minima reach the bound. (Rectangles alone cannot prune here: single coordinates of
unrelated texts of like length differ less than the threshold allows.) Pairs that
the tree leaves are bounded once more by fine points, whose groups grow in number with
the set, before the sets themselves are made anew from the texts and compared.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import bitmap, components, marked, text_or_empty, written

#: Coordinates of a point.
GROUPS = 64
#: Words a task remembers; only memory and speed depend on it.
CACHED_WORDS = 100_000
#: Points of one R-tree; keys with more documents are cut into pairs of blocks.
BLOCK = 256
#: Fine points have at most 4096 groups; with fewer the bound is weaker, never wrong.
FINE_BITS = 12
#: Words hashed in one go; only memory and speed depend on it.
WORDS_AT_ONCE = 20_000
#: Keys a task holds before it passes them on.
HELD_KEYS = 400_000
#: Keys are dealt to 2048 slices.
SLICE_BITS = 11
PIVOT_ROUNDS = 1

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
S30, S27, S31 = (np.uint64(x) for x in (30, 27, 31))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    x = (x ^ (x >> S30)) * M2
    x = (x ^ (x >> S27)) * M3
    return x ^ (x >> S31)


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_sets(texts: Iterable[str], size: int, known: WordHashes) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Words are separated by ASCII white space, A-Z count as a-z. A text with
    fewer words than a shingle is one shingle; without words it has none.
    Texts are hashed together, some ten thousand words at a time.
    """
    out: list[np.ndarray] = []
    held: list[list[bytes]] = []
    waiting = 0

    def finish() -> None:
        if len(known) > CACHED_WORDS:
            known.clear()
        h = np.fromiter(map(known.__getitem__, chain.from_iterable(held)), np.uint64, waiting)
        whole, start = _rolled(h, size), 0
        for words in held:
            n = len(words)
            if n >= size:
                found = whole[start: start + n - size + 1]
                found.sort()
                new = np.empty(len(found), bool)
                new[0] = True
                np.not_equal(found[1:], found[:-1], out=new[1:])
                out.append(found[new])
            else:
                out.append(_rolled(h[start: start + n], n))
            start += n
        held.clear()

    for text in texts:
        words = text.encode().lower().split()
        held.append(words)
        waiting += len(words)
        if waiting > WORDS_AT_ONCE:
            finish()
            waiting = 0
    finish()
    return out


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of ``size`` consecutive word hashes, at each place that has so many."""
    n = len(h) - size + 1
    if size == 0 or n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, size, np.uint64) * M1
    for k in range(size):
        out = mix((out ^ h[k: k + n]) + M1)
    return out


class Bands:
    """Size bands, and the number of chunks that two documents of a band must share one of."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den, self.ratio = num, den, ratio
        self.edges, self.chunks, self.spare = [1], [], []

    def reach(self, n: int) -> None:
        while self.edges[-1] <= n:
            low = self.edges[-1]
            high = max(low + 1, int(low * self.ratio))
            # |A - B| + |B - A| is at most (1 - t) / t of the smaller set.
            differ = (high - 1) * (self.den - self.num) // self.num
            # Chunks that may be empty in a document without hiding its only
            # agreeing one: about three deviations above the expected number.
            spare = 0
            for _ in range(16 if differ else 0):
                empty = (differ + 1 + spare) * math.exp(-low / (differ + 1 + spare))
                spare = min(differ, math.ceil(empty + 3 * math.sqrt(empty)))
            self.chunks.append(differ + 1 + spare if differ else 0)
            self.spare.append(spare)
            self.edges.append(high)

    def of(self, n: int) -> list[int]:
        """Bands in which a set of n shingles can meet a smaller or equally banded one."""
        self.reach(n)
        own = bisect_right(self.edges, n) - 1
        least = -(-n * self.num // self.den)
        return [b for b in range(bisect_right(self.edges, least) - 1, own + 1) if b >= 0 and self.chunks[b]]


def chunk_keys(hashes: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """Keys of a set: the content of each of its chunks in each of its bands."""
    out = []
    if len(hashes) == 0:
        return out
    spread, value = mix(hashes ^ M3), mix(hashes + M2)
    for b in bands.of(len(hashes)):
        m = bands.chunks[b]
        chunk = ((spread >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, chunk, value)
        used = np.flatnonzero(np.bincount(chunk, minlength=m))
        if m - len(used) > bands.spare[b]:
            used = np.arange(m)
        out.append(mix(total[used] + mix(used.astype(np.uint64) + np.uint64(b + 1 << 40) + M1)))
    return out


def _point(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=GROUPS)


def _numbers(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit number for each set."""
    sizes = np.array([len(s) for s in sets], np.uint64)
    ends = np.cumsum(sizes).astype(np.int64)
    starts = ends - sizes.astype(np.int64)
    hashes = np.concatenate([np.empty(0, np.uint64), *sets])

    def sums(values: np.ndarray) -> np.ndarray:
        # Sums wrap around, and so do their differences.
        up_to = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return up_to[ends] - up_to[starts]

    return mix(mix(sums(mix(hashes)) + sizes) ^ sums(mix(hashes ^ M1)))


def _read(column: pa.Array, size: int, known: WordHashes) -> tuple[list[np.ndarray], pa.Array]:
    """Sets of the texts of a column, and their numbers."""
    sets = shingle_sets(column.to_pylist(), size, known)
    return sets, pa.array(_numbers(sets).view(np.int64))


def _digested(docs: DataFrame, size: int) -> DataFrame:
    """id, n, number of the set."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for frame in frames:
            sets, numbers = _read(frame.column(1), size, known)
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), pa.array([len(s) for s in sets], pa.int64()), numbers], names=["id", "n", "set"])

    return docs.select("id", "body").mapInArrow(run, "id long, n long, set long")


def _sets_and_keys(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(id, n, set, key): the set of every row (key is null), and (set, key) of every key that several sets share.

    Texts are read once. Of a key its slice, 32 more bits and its set travel,
    packed per slice; a slice is one of 2048 parts of all keys, and what is not
    repeated in it ends there. Keys that agree by chance only add candidates.
    """
    schema = "slice int, id long, n long, set long, keys binary, sets binary"
    names = ["slice", "id", "n", "set", "keys", "sets"]

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bands = WordHashes(), Bands(num, den)
        held: list[np.ndarray] = []
        owners: list[int] = []
        counts: list[int] = []
        waiting = 0

        def flushed() -> pa.RecordBatch:
            keys = np.concatenate([np.empty(0, np.uint64), *held])
            sets = np.repeat(np.array(owners, np.int64), counts)
            at = (keys >> np.uint64(64 - SLICE_BITS)).astype(np.uint16)
            order = np.argsort(at, kind="stable")
            slices, starts = np.unique(at[order], return_index=True)
            rest = (keys[order] >> np.uint64(32 - SLICE_BITS)).astype("<u4")
            ends = [*starts[1:].tolist(), len(keys)]
            cut = list(zip(starts.tolist(), ends, strict=True)) if len(slices) else []
            sets = sets[order].astype("<i8")
            none = pa.nulls(len(slices), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(slices.astype(np.int32)), none, none, none,
                 pa.array([rest[x:y].tobytes() for x, y in cut], pa.binary()),
                 pa.array([sets[x:y].tobytes() for x, y in cut], pa.binary())], names=names)

        here: set[int] = set()
        for frame in frames:
            sets, numbers = _read(frame.column(1), size, known)
            ids = frame.column(0)
            # Rows are dealt by id and set, so that copies lie apart.
            spread = mix(numbers.to_numpy().view(np.uint64) ^ ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64))
            none = pa.nulls(len(sets), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array((spread >> np.uint64(64 - SLICE_BITS)).astype(np.int32)), ids,
                 pa.array([len(s) for s in sets], pa.int64()), numbers, none, none], names=names)
            for given, own, number in zip(ids.is_valid().to_pylist(), sets, numbers.to_pylist(), strict=True):
                if not given or number in here:
                    continue
                here.add(number)
                for keys in chunk_keys(own, bands):
                    held.append(keys)
                    owners.append(number)
                    counts.append(len(keys))
                    waiting += len(keys)
                if waiting > HELD_KEYS:
                    yield flushed()
                    here, waiting = set(), 0
                    held.clear(), owners.clear(), counts.clear()
        yield flushed()

    def shared(part: pa.Table) -> pa.Table:
        packed = part.filter(part.column("keys").is_valid())
        keys = np.frombuffer(b"".join(packed.column("keys").to_pylist()), "<u4")
        sets = np.frombuffer(b"".join(packed.column("sets").to_pylist()), "<i8")
        order = np.argsort(keys)
        same = np.diff(keys[order]) == 0
        order = order[np.append(same, False) | np.insert(same, 0, False)] if len(keys) else order
        order = order[np.lexsort((sets[order], keys[order]))]
        keys, sets = keys[order].astype(np.int64), sets[order]
        # A set counts once for a key, and a key needs two sets.
        new = np.ones(len(keys), bool)
        new[1:] = (np.diff(keys) != 0) | (np.diff(sets) != 0)
        keys, sets = keys[new], sets[new]
        _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
        several = n[at] > 1 if len(keys) else np.empty(0, bool)
        keys, sets = keys[several], sets[several]
        rows = part.filter(part.column("keys").is_null()).select(["id", "n", "set"])
        here = part.column("slice")[0].as_py() << 32
        none = pa.nulls(len(keys), pa.int64())
        return pa.concat_tables([
            rows.append_column("key", pa.nulls(len(rows), pa.int64())),
            pa.table({"id": none, "n": none, "set": pa.array(sets, pa.int64()), "key": pa.array(keys | here, pa.int64())})])

    return docs.select("id", "body").mapInArrow(read, schema).groupBy("slice").applyInArrow(
        shared, "id long, n long, set long, key long")


def _fine_point(hashes: np.ndarray) -> np.ndarray:
    """Count vector of two to four shingles a group, in a power of two of groups."""
    bits = min(max(len(hashes).bit_length() - 2, 6), FINE_BITS)
    return np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _packed(counts: np.ndarray) -> bytes:
    """A fine point in as few bytes a group as its largest count needs; the first byte says how many."""
    kind = np.min_scalar_type(int(counts.max(initial=0))).newbyteorder("<")
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def _unpacked(value: pa.BinaryScalar) -> np.ndarray:
    raw = np.frombuffer(value.as_buffer(), np.uint8)
    return raw[1:].view(f"<u{raw[0]}")


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """A count vector in fewer groups: neighbouring groups are added up."""
    return counts.reshape(groups, -1).sum(1)


def _fine_reaches(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether the summed minima of two fine points reach the bound."""
    groups = min(len(x), len(y))
    shared = np.minimum(_folded(x, groups), _folded(y, groups)).sum()
    return bool(shared * (num + den) >= num * (x.sum() + y.sum()))


def _points(docs: DataFrame, size: int) -> DataFrame:
    """doc, id (number of the set), n, point and fine point."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for frame in frames:
            sets, numbers = _read(frame.column(1), size, known)
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), numbers,
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_point(s) for s in sets], pa.list_(pa.int32())),
                 pa.array([_packed(_fine_point(s)) for s in sets], pa.binary())],
                names=["doc", "id", "n", "point", "fine"],
            )

    return docs.select("id", "body").mapInArrow(run, "doc long, id long, n long, point array<int>, fine binary")


def _hashes(docs: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """(id, hashes) of the sets ``wanted`` (set, rep), made anew from the text of their row ``rep``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for frame in frames:
            sets, numbers = _read(frame.column(1), size, known)
            yield pa.RecordBatch.from_arrays(
                [frame.column(0), numbers, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc", "id", "hashes"])

    some = marked(docs, bitmap(wanted, "rep"), "id").where("is_set").select("id", "body")
    made = some.mapInArrow(run, "doc long, id long, hashes array<long>")
    # A row may be given twice, and an id may have several texts.
    same = (F.col("id") == F.col("set")) & (F.col("doc") == F.col("rep"))
    return written(made.join(wanted, same).select("id", "hashes").dropDuplicates(["id"]), "jaccard-hashes")


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, id) of keys that several sets share; of keys with the same sets, one."""
    several = rows.groupBy("key").agg(
        F.count("*").alias("m"), F.sum(F.pmod(F.xxhash64("id"), F.lit(1 << 40))).alias("who1"),
        F.sum(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1 << 40))).alias("who2"),
    ).where("m > 1")
    chosen = several.groupBy("m", "who1", "who2").agg(F.min("key").alias("key")).select("key")
    return rows.join(chosen, "key", "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, hashes_of: Callable, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: points first, then fine points, sets for the rest."""
    kind = pairs.schema["a"].dataType.simpleString()

    def of(rows: DataFrame, side: str, *columns: str) -> DataFrame:
        return rows.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])

    def both(rows: DataFrame, of_sets: DataFrame, *columns: str) -> DataFrame:
        return rows.join(of(of_sets, "a", *columns), "a").join(of(of_sets, "b", *columns), "b")

    def fine(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep = [
                _fine_reaches(_unpacked(x), _unpacked(y), num, den)
                for x, y in zip(frame.column(2), frame.column(3), strict=True)]
            yield frame.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def exact(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keep = []
            for x, y in zip(frame.column(2), frame.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(shared * (num + den) >= num * (len(x) + len(y)))
            yield frame.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    schema = f"a {kind}, b {kind}"
    overlap = F.aggregate(
        F.zip_with("point_a", "point_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = both(pairs, sets, "n", "point").where(
        overlap * (num + den) >= (F.col("n_a") + F.col("n_b")) * num).select("a", "b")
    possible = written(
        both(near, sets, "fine").select("a", "b", "fine_a", "fine_b").mapInArrow(fine, schema), "jaccard-possible")
    hashes = hashes_of(possible.select(F.col("a").alias("id")).union(possible.select("b")).distinct())
    return both(possible, hashes, "hashes").select("a", "b", "hashes_a", "hashes_b").mapInArrow(exact, schema)


class CountTree:
    """R-tree over count points, packed in order of size and then of coordinates."""

    def __init__(self, points: np.ndarray, fanout: int = 16):
        self.points, self.fanout = points, fanout
        total = points.sum(1)
        self.order = np.lexsort((points[:, 0], points[:, 1], total // max(1, int(total.mean()) // 8)))
        level = (points[self.order], total[self.order])
        self.levels = []
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), fanout)
            level = np.maximum.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts)
            self.levels.append(level)

    def reaching(self, point: np.ndarray, num: int, den: int) -> np.ndarray:
        """Indices of the points whose summed minima with one point reach the bound."""
        n = point.sum()
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.zeros(1, int)
        below = [len(high) for high, _ in self.levels[:-1]][::-1] + [len(self.order)]
        for (high, least), size in zip(reversed(self.levels), below, strict=False):
            ok = np.minimum(high[at], point).sum(1) * (num + den) >= num * (n + least[at])
            at = (at[ok][:, None] * self.fanout + np.arange(self.fanout)).ravel()
            at = at[at < size]
        at = self.order[at]
        found = self.points[at]
        return at[np.minimum(found, point).sum(1) * (num + den) >= num * (n + found.sum(1))]


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows of (key, id, ...) once per pair of blocks of their key; blocks are cut by hash."""
    sizes = rows.groupBy("key").count().select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    return (
        rows.join(sizes, "key")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )


def _tree_candidates(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Candidates (key, a, b) between different components of a key, by R-tree and fine points.

    ``rows``: key, id, comp, fine. Large keys are cut into pairs of blocks, each
    searched on its own, so that a task holds two blocks. A candidate connects its
    sets for the rest of the search, so that a pair of blocks gives fewer
    candidates than it has rows; where one is refuted later, its key has to be
    searched again.
    """
    grouped = _blocks(rows).groupBy("key", "low", "high").agg(
        F.collect_list(F.struct("id", "comp", "block", "fine")).alias("rows")).select("key", "low", "high", "rows")

    def of_group(low: int, high: int, group: pa.StructArray) -> list[tuple[int, int]]:
        ids, comp, block = (group.field(c).to_numpy() for c in ("id", "comp", "block"))
        fine = [_unpacked(x).astype(np.int64) for x in group.field("fine")]
        points = np.array([_folded(x, GROUPS) for x in fine])
        _, label = np.unique(comp, return_inverse=True)
        here, others = np.flatnonzero(block == low), np.flatnonzero(block == high)
        found = []
        if len(here) == 0 or len(others) == 0 or label.max() == 0:
            return found
        tree = CountTree(points[others])
        for i in here.tolist():
            near = others[tree.reaching(points[i], num, den)]
            if low == high:
                near = near[near > i]
            near = near[label[near] != label[i]]
            while len(near):
                j, near = int(near[0]), near[1:]
                if _fine_reaches(fine[i], fine[j], num, den):
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    label[label == label[j]] = label[i]
                    near = near[label[near] != label[i]]
        return found

    def search(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            keys, out = [], []
            for key, low, high, group in zip(*(frame.column(c) for c in range(4)), strict=True):
                found = of_group(low.as_py(), high.as_py(), group.values)
                keys += [key.as_py()] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([a for a, _ in out], pa.int64()),
                 pa.array([b for _, b in out], pa.int64())], names=["key", "a", "b"])

    return grouped.mapInArrow(search, "key long, a long, b long")


def _tree_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components of a cluster, verified where they are found.

    ``rows``: key (of the cluster), id, comp, point, hashes. Pairs that earlier links already
    connect are skipped, so that a pair of blocks gives fewer links than it has rows.
    """
    blocked = _blocks(rows)

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, comp, block = (part.column(c).to_numpy() for c in ("id", "comp", "block"))
        points = np.array(part.column("point").combine_chunks().values.to_numpy()).reshape(len(ids), -1)
        hashes = part.column("hashes").chunk(0)
        low, high = part.column("low")[0].as_py(), part.column("high")[0].as_py()
        rows, others = np.flatnonzero(block == low), np.flatnonzero(block == high)
        _, label = np.unique(comp, return_inverse=True)
        found = []
        if len(rows) and len(others):
            tree = CountTree(points[others])
            for i in rows.tolist():
                near = others[tree.reaching(points[i], num, den)]
                if low == high:
                    near = near[near > i]
                own = None
                near = near[label[near] != label[i]]
                while len(near):
                    j, near = int(near[0]), near[1:]
                    own = hashes[i].values.to_numpy() if own is None else own
                    that = hashes[j].values.to_numpy()
                    shared = len(own) + len(that) - len(np.unique(np.concatenate([own, that])))
                    if shared * (num + den) >= num * (len(own) + len(that)):
                        found.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
                        near = near[label[near] != label[i]]
        return pa.table({
            "a": pa.array([min(p) for p in found], pa.int64()), "b": pa.array([max(p) for p in found], pa.int64())})

    return blocked.groupBy("key", "low", "high").applyInArrow(search, "a long, b long")


def _links(members: DataFrame, sets: DataFrame, hashes_of: Callable, num: int, den: int) -> DataFrame:
    """Links that connect all sets that links of the join connect."""

    def still_open(keys: DataFrame, links: DataFrame, least: int) -> DataFrame:
        """Rows of ``keys`` with their component, of keys with several components and ``least`` sets."""
        comps = components(links, "a", "b", "jaccard-components")
        placed = keys.join(comps, "id", "left").select(
            "key", "id", F.coalesce("component_id", "id").alias("comp"))
        several = placed.groupBy("key").agg(
            F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")
        ).where((F.col("x") != F.col("y")) & (F.col("m") >= least))
        return written(placed.join(several.select("key"), "key", "left_semi"), "jaccard-open")

    found = None
    open_ = members.withColumn("comp", F.col("id"))
    for turn in range(PIVOT_ROUNDS):
        # The pivot of a key, the same for many keys: the smallest hash among its documents.
        order = F.xxhash64(F.lit(turn), "id")
        pivots = open_.groupBy("key").agg(F.min_by(F.struct("id", "comp"), order).alias("p"))
        pairs = (
            open_.join(pivots, "key").where("comp <> p.comp")
            .select(F.col("p.id").alias("a"), F.col("id").alias("b")).distinct()
        )
        new = _verified(pairs, sets, hashes_of, num, den)
        found = written(new if found is None else found.union(new), "jaccard-links")
        # Two sets are settled by the one comparison they had.
        open_ = still_open(members, found, 3)
        if open_.isEmpty():
            return found
    candidates = written(
        _tree_candidates(open_.join(sets.select("id", "fine"), "id"), num, den), "jaccard-candidates")
    new = written(_verified(candidates.select("a", "b").distinct(), sets, hashes_of, num, den), "jaccard-links")
    refuted = candidates.join(new, ["a", "b"], "left_anti").select("key", "a")
    again = still_open(open_.join(refuted, "key", "left_semi").select("key", "id"), found.union(new), 3)
    if again.isEmpty():
        return found.union(new)
    # Links and candidates connect all sets whose fine points reach the bound, directly or not:
    # they are one cluster, so that each set travels once.
    near = components(found.union(candidates.select("a", "b")), "a", "b", "jaccard-clusters")
    near = near.select("id", F.col("component_id").alias("key"))
    doubtful = near.join(refuted.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("key").distinct()
    clustered = written(
        near.join(doubtful, "key", "left_semi").join(again.select("id", "comp").distinct(), "id"), "jaccard-clustered")
    hashes = hashes_of(clustered.select("id"))
    return found.union(new).union(
        _tree_links(clustered.join(sets.select("id", "point"), "id").join(hashes, "id"), num, den))


def _placed(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """id, n, set and component_id of each row of (id, body)."""
    stored = written(_sets_and_keys(docs, shingle, num, den), "shingle-sets")
    keyed = stored.where("key is null").select("id", "n", "set")
    linkable = F.col("id").isNotNull() & (F.col("n") > 0)
    # Of copies one is compared. A set goes by its own number, since an id may have several texts.
    same = written(keyed.where(linkable).groupBy("set").agg(F.min("id").alias("rep")), "shingle-same")
    named = docs.where("id is not null")
    rows = stored.where("key is not null").select(F.col("set").alias("id"), "key")
    members = written(shared_keys(rows), "shared-keys")
    involved = written(
        members.select(F.col("id").alias("set")).distinct().join(same, "set").select("set", "rep"), "shared-sets")
    some = marked(named, bitmap(involved, "rep"), "id").where("is_set").select("id", "body")
    sets = marked(_points(some, shingle), bitmap(involved, "set", "rep"), "id", "doc").where("is_set")
    sets = written(sets.drop("is_set", "doc"), "shingle-points")
    # The bitmaps let some copies through; of these sets, one row stays.
    often = written(sets.groupBy("id").count().where("count > 1").select("id"), "shingle-often")
    sets = sets.join(often, "id", "left_anti").union(sets.join(often, "id", "left_semi").dropDuplicates(["id"]))

    def hashes_of(ids: DataFrame) -> DataFrame:
        return _hashes(named, shingle, involved.join(ids, F.col("set") == F.col("id"), "left_semi"))

    comps = components(_links(members, sets, hashes_of, num, den), "a", "b", "jaccard-result")
    linked = same.join(comps, F.col("set") == F.col("id"), "left").select(
        "set", "rep", F.coalesce("component_id", "set").alias("comp"))
    smallest = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    settled = linked.join(smallest, "comp").select("set", "component_id")
    return keyed.where(linkable).join(settled, "set").select("id", "n", "set", "component_id").union(
        keyed.where(~linkable).select("id", "n", "set", F.col("id").alias("component_id")))


def jaccard_components(
    df: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links).

    Two rows link when the sets of their word shingles have a Jaccard similarity
    of at least ``num / den``. A null or empty text, or one of white space, has
    no shingles and links with nothing. Texts of equal sets (also repeated rows)
    are one member of the join; each text of a repeated id is a member of its own. Ids must be integers; a row with a null id has
    no links and no component. An empty table gives an empty result; other
    columns are ignored. Hashes of 64 bits stand for shingles and sets.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("body"))
    return _placed(docs, shingle, num, den).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(
    df: DataFrame, shingle: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of their component, all columns unchanged.

    Of a repeated id, each text is judged on its own; rows without an id or
    without words stay; an empty table gives an empty result.
    """
    # The given columns travel as one, so that no name can clash.
    rows = df.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("body"))
    found = written(_placed(rows.select("id", "body"), shingle, num, den), "jaccard-kept")
    per_id = found.where("id is not null").groupBy("id").agg(
        F.count("*").alias("n"), F.count_if(F.col("id") != F.col("component_id")).alias("n_gone"))
    gone = written(per_id.where("n_gone > 0").select("id", (F.col("n_gone") < F.col("n")).alias("mixed")), "jaccard-gone")
    kept = rows.join(gone, "id", "left_anti").select("row.*")
    mixed = gone.where("mixed")
    if mixed.isEmpty():
        return kept
    # Ids of which some texts go: their rows are matched by text.
    some = written(rows.join(mixed, "id", "left_semi"), "jaccard-mixed")
    texts = written(
        some.select("id", "body").distinct().withColumn("number", F.monotonically_increasing_id()), "jaccard-texts")
    numbered = _digested(texts.select(F.col("number").alias("id"), "body"), shingle).select(
        F.col("id").alias("number"), "set")
    leaving = texts.join(numbered, "number").join(
        found.where("id <> component_id").select("id", "set").distinct(), ["id", "set"]).select("id", "body")
    return kept.unionByName(some.join(leaving, ["id", "body"], "left_anti").select("row.*"))
