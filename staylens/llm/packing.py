"""Best-fit packing of token sequences by exact complements (operator 1).

Every text is encoded once; texts longer than a sequence are cut into full
pieces, the first of which may be shorter. Packing needs only how many pieces
there are of each length, at most ``capacity`` numbers: a plan is made from
these counts. Single, pair and triple sums of the lengths still available are
indexed; the longest open piece takes a combination that fills its gap exactly,
as often as the counts allow, and where there is none it is packed best-fit. Each step of the
plan uses up at least one length, so a plan has at most ``capacity`` steps at
any input size. Pieces then find their place from their rank among the pieces of
the same length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from staylens.llm import byte_bpe
from staylens.llm.common import partitions, text_or_empty, written

CAPACITY = 1024
END_ID = 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and the ids, little-endian, if asked)."""
    kind = df.schema[id_col].dataType
    end = int(end_id).to_bytes(4, "little")

    def encode(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_bpe.text_encoder(tokenizer_path)
        for frame in frames:
            keys, at, rows = frame.column(0), [], []
            for i, text in enumerate(frame.column(1)):
                ids = encoder(text.as_py()) + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start: 4 * (start + length)]
                    at.append(i)
                    rows.append((k, start, length, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(at, pa.int64())), pa.array(columns[0], pa.int32()),
                    pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                    pa.array(columns[3], pa.int64()),
                    *([pa.array(columns[4], pa.binary())] if with_ids else []),
                ],
                names=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])],
            )

    schema = f"id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).mapInArrow(
        encode, schema + (", ids binary" if with_ids else "")
    )


def _parts_of(gap: int, left: np.ndarray, used: dict[int, int], most: int = 3) -> list[int] | None:
    """One, two or three available lengths (``most`` at most) that sum to the gap, longest first."""

    def enough(*lengths: int) -> bool:
        need = dict(used)
        for n in lengths:
            need[n] = need.get(n, 0) + 1
        return all(left[n] >= k for n, k in need.items())

    if enough(gap):
        return [gap]
    if most == 1:
        return None
    open_ = np.flatnonzero(left[:gap] > 0)
    # Pair sums: a + b = gap with a >= b.
    first = open_[(2 * open_ >= gap) & (left[gap - open_] > 0)][::-1]
    for a in first.tolist():
        if enough(a, gap - a):
            return [a, gap - a]
    if most == 2:
        return None
    # Triple sums: the pair sums of what is available, looked up per first length.
    is_open = left[: gap + 1] > 0
    is_open[0] = False
    sums = np.convolve(is_open, is_open)[: gap + 1] > 0
    for a in open_[(3 * open_ >= gap) & sums[gap - open_]][::-1].tolist():
        rest = gap - a
        for b in open_[(open_ <= min(a, rest - 1)) & (2 * open_ >= rest)][::-1].tolist():
            if left[rest - b] > 0 and enough(a, b, rest - b):
                return [a, b, rest - b]
    return None


Steps = list[tuple[int, list[tuple[int, int]]]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Steps:
    """Steps (number of sequences, [(length, pieces of it per sequence)]).

    Exact fills with more parts use up short pieces that other sequences would
    need, so plans with at most three, two and one parts are made and the one
    with the fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda steps: sum(times for times, _ in steps))


def _plan(counts: dict[int, int], capacity: int, most: int) -> Steps:
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        left[n] = k
    steps: Steps = []

    def take(lengths: list[int]) -> None:
        per: dict[int, int] = {}
        for n in lengths:
            per[n] = per.get(n, 0) + 1
        times = int(min(left[n] // k for n, k in per.items()))
        for n, k in per.items():
            left[n] -= times * k
        steps.append((times, sorted(per.items(), reverse=True)))

    def fill(n: int) -> list[int]:
        """An exact fill if there is one, else the longest piece that fits and so on."""
        chosen, used, gap = [n], {n: 1}, capacity - n
        while gap:
            if found := _parts_of(gap, left, used, most):
                return chosen + found
            spare = left[: gap + 1].copy()
            for length, k in used.items():
                if length <= gap:
                    spare[length] -= k
            fits = np.flatnonzero(spare > 0)
            if not fits.size:
                break
            n = int(fits[-1])
            chosen.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        return chosen

    for n in range(capacity, 0, -1):
        while left[n]:
            take(fill(n))
    return steps


def places(steps: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """For each run of ranks of one length: where its sequences and offsets start."""
    rows, taken, first = [], np.zeros(capacity + 1, dtype=np.int64), 0
    for times, lengths in steps:
        offset = 0
        for n, k in lengths:
            rows.append((n, int(taken[n]), times, first, offset))
            taken[n] += times * k
            offset += n * k
        first += times
    rows.sort()
    names = ["length", "rank", "times", "sequence", "offset"]
    return {c: np.array([r[i] for r in rows], dtype=np.int64) for i, c in enumerate(names)}


def ranked(rows: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """0-based rank of each piece among those of its length.

    A length that many pieces share is split by hash into groups of about a
    quarter of a partition; ranks are counted inside the groups, and groups are
    put one after another by their sizes.
    """
    total = max(1, sum(counts.values()))
    groups = 4 * partitions(rows.sparkSession)
    split = F.array(*[F.lit(1 + counts.get(n, 0) * groups // total) for n in range(capacity + 1)])
    rows = rows.withColumn(
        "bin", F.pmod(F.xxhash64("id", "piece", "start"), F.get(split, F.col("length").cast("int"))).cast("int")
    )
    before = Window.partitionBy("length").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "bin").count().select(
        "length", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("length", "bin").orderBy("id", "piece", "ids_crc32")
    return (
        rows.withColumn("rank", F.row_number().over(inside).cast("long") - 1)
        .join(starts, ["length", "bin"]).withColumn("rank", F.col("rank") + F.col("base")).drop("bin", "base")
    )


def pack(
    df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Sequences hold at most
    ``capacity`` ids and are gapless from 0; pieces of equal length may swap
    places. Repeated rows are packed as often as they occur; a null id stays
    null. An empty table gives no rows. Other columns are ignored.
    """
    rows = written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(plan(counts, capacity), capacity)

    def put(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = at["length"] << 44 | at["rank"]
        for frame in frames:
            length, rank = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            run = np.searchsorted(known, length << 44 | rank, side="right") - 1
            copy, turn = np.divmod(rank - at["rank"][run], at["times"][run])
            table = pa.Table.from_batches([frame]).drop_columns(["rank"])
            table = table.append_column("sequence_id", pa.array(at["sequence"][run] + turn))
            table = table.append_column("offset", pa.array(at["offset"][run] + copy * length))
            yield from table.to_batches()

    placed = ranked(rows, counts, capacity)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.drop("rank").schema)
    out = placed.mapInArrow(put, schema + ", sequence_id long, offset long")
    names = [c for c in ("piece", "start", "length", "ids_crc32", "ids") if c in out.columns]
    return out.select(F.col("id").alias(id_col), *names, "sequence_id", "offset")


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The packed sequences themselves (from ``pack(with_ids=True)``): ids and the pieces they hold."""
    part = F.struct("offset", "ids", F.col(id_col).alias("id"), "piece", "length")
    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["id"], p["piece"], p["offset"], p["length"])).alias("pieces"),
    )
