"""Near-duplicate vectors through spherical k-means cells (operator 5).

Directions are clustered on a bounded sample. Every vector has the cell of its
nearest centre as its home, and visits each cell whose centre is at most
``margin`` degrees farther. Inside a cell, home vectors are compared with home
vectors and visitors by blocked matrix products. By the triangle inequality the
two detours of a linked pair add up to at most twice the threshold's angle, so with
that angle as ``margin``, the default, one of them visits the other's cell and no
link is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from staylens.llm.common import components, written

THRESHOLD = 0.98
#: Degrees added to the threshold's angle for rounding.
ROUNDING = 0.01
#: Vectors the centres are fitted on, at most; and bytes of them.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 64_000_000
MAX_CELLS = 1024
BLOCK = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres of unit rows; empty cells take over the worst-placed rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        scores = x @ centres.T
        home = scores.argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=k) == 0)
        sums[empty] = x[np.argsort(scores.max(1))[: len(empty)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows, in double precision, of a list column whose rows have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their vector, and one row per label and different vector."""
    vector = F.col(vector_col)
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))
    keyed = df.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), usable.alias("usable"), vector.alias("vector"),
        # 128 bits stand for the vector.
        F.xxhash64(vector).alias("k1"), F.xxhash64(F.lit("again"), vector).alias("k2"),
    )
    reps = keyed.where("usable and id is not null").groupBy("label", "k1", "k2").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    return keyed.drop("vector"), reps.withColumn("dim", F.size("vector"))


def fit_centres(reps: DataFrame, dim: int, n: int) -> np.ndarray:
    """Centres of one dimension, fitted on a sample of at most SAMPLE_ROWS rows and SAMPLE_BYTES."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    chosen = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("k1", "k2")).limit(most).select("vector")
    x = _matrix(chosen.toArrow().column(0).combine_chunks())
    return spherical_kmeans(x, max(1, min(MAX_CELLS, int(math.sqrt(n)), len(x) // 8)))


def cells(reps: DataFrame, centres: dict[int, np.ndarray], margin: float) -> DataFrame:
    """Each vector once per cell it is in: home, and the cells it visits."""
    kind = reps.schema["label"].dataType.simpleString()
    key = reps.schema["rep"].dataType.simpleString()

    def assign(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            dims = frame.column(4).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = frame.filter(pa.array(dims == dim))
                for start in range(0, part.num_rows, BLOCK):
                    rows = part.slice(start, BLOCK)
                    angle = np.degrees(np.arccos(np.clip(_matrix(rows.column(3)) @ centres[dim].T, -1, 1)))
                    home = angle.argmin(1)
                    near = angle <= angle[np.arange(len(home)), home][:, None] + margin
                    at, cell = np.nonzero(near)
                    visits = [np.flatnonzero(row).astype(np.int32) for row in near]
                    take = rows.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*take.columns, pa.array(home[at], pa.int32()), pa.array(cell, pa.int32()),
                         pa.array([visits[i] for i in at], pa.list_(pa.int32()))],
                        names=["label", "rep", "n", "vector", "dim", "home", "cell", "visits"],
                    )

    return reps.select("label", "rep", "n", F.col("vector").cast("array<double>"), "dim").mapInArrow(
        assign,
        f"label {kind}, rep {key}, n long, vector array<double>, dim int, home int, cell int, visits array<int>",
    )


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of n points reaches over the links i-j."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def compare(placed: DataFrame, threshold: float) -> DataFrame:
    """Links inside cells: for each vector the linked rows, and links that span each group of a task.

    A cell of many vectors is cut into blocks by hash, and each pair of blocks
    is a group of its own, so no task holds more than two blocks.
    """
    group = ["label", "dim", "cell"]
    sizes = placed.groupBy(*group).count().select(
        *group, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    blocked = (
        placed.join(sizes, group)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    )
    key = placed.schema["rep"].dataType.simpleString()

    def links(_: tuple, part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        x = _matrix(part.column("vector").combine_chunks())
        rep, n, home, block = (part.column(c).to_numpy() for c in ("rep", "n", "home", "block"))
        cell, low, high = (part.column(c)[0].as_py() for c in ("cell", "low", "high"))
        visits = part.column("visits").to_pylist()
        wide = np.full((len(visits), max(map(len, visits))), -1)
        for i, v in enumerate(visits):
            wide[i, : len(v)] = v
        found_i, found_j = [], []
        rows = np.flatnonzero(block == low)
        columns = np.flatnonzero(block == high)
        for start in range(0, len(rows), 256):
            some = rows[start: start + 256]
            a, b = np.nonzero(x[some] @ x[columns].T >= threshold)
            i, j = some[a], columns[b]
            if low == high:
                i, j = i[i < j], j[i < j]
            # A pair counts where one of the two is at home; in the lower of
            # the two homes if each visits the other's.
            at_home_i, at_home_j = home[i] == cell, home[j] == cell
            back_i = (wide[i] == home[j][:, None]).any(1)
            back_j = (wide[j] == home[i][:, None]).any(1)
            counts = (at_home_i & at_home_j) | (
                at_home_i & ~at_home_j & ((cell < home[j]) | ~back_i)
            ) | (at_home_j & ~at_home_i & ((cell < home[i]) | ~back_j))
            found_i.append(i[counts])
            found_j.append(j[counts])
        i, j = np.concatenate(found_i or [np.empty(0, int)]), np.concatenate(found_j or [np.empty(0, int)])
        linked = np.bincount(i, weights=n[j], minlength=len(rep)) + np.bincount(j, weights=n[i], minlength=len(rep))
        root = _smallest(len(rep), i, j)
        some = np.flatnonzero(linked > 0)
        return pa.table({
            "rep": pa.array(rep[some]), "links": pa.array(linked[some].astype(np.int64)),
            "root": pa.array(rep[root[some]]),
        })

    return blocked.groupBy(*group, "low", "high").applyInArrow(links, f"rep {key}, links long, root {key}")


def near_dedup(
    df: DataFrame, threshold: float = THRESHOLD, margin: float | None = None,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Two vectors of equal label (not null) and length link when their cosine in
    double precision is at least ``threshold``. Null, empty and zero vectors and
    vectors with null or non-finite components link with nothing and stay.
    Equal vectors are compared once and counted as often as they occur; so are
    repeated rows. Of a component the smallest id stays. A row with a null id
    has no links. An empty table gives an empty result; other columns are
    ignored.
    """
    keyed, reps = distinct_vectors(df, id_col, vector_col, label_col)
    reps = written(reps, "vectors")
    # One row per vector length.
    sizes = {r["dim"]: r["count"] for r in reps.groupBy("dim").count().collect()}
    centres = {dim: fit_centres(reps, dim, n) for dim, n in sizes.items()}
    if margin is None:
        margin = math.degrees(math.acos(threshold)) + ROUNDING
    found = written(compare(cells(reps, centres, margin), threshold), "vector-links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found, "rep", "root", "vector-components")
    settled = (
        reps.select("label", "k1", "k2", "rep", "n").join(linked, "rep", "left")
        .join(joined, F.col("rep") == F.col("id"), "left")
        .select("label", "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component_id", "rep").alias("component_id"))
    )
    usable = F.col("usable") & F.col("id").isNotNull()
    out = keyed.where(usable).join(settled, ["label", "k1", "k2"]).select("id", "n_links", "component_id").union(
        keyed.where(~usable).select("id", F.lit(0).cast("long"), "id"))
    return out.select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
