"""Chunking, embedding and nearest-neighbour search.

Search joins blocks, not rows. Items are packed where they lie into blocks of
vectors that share a key (a leaf of the index, a set of restricts, or one key for
all); queries are packed the same way and copied once per salt of their key.
The two meet in an equi-join: query blocks that prove small are broadcast, others meet
the item blocks in a shuffle, where the salts keep a hot key spread out. Salts grow with the
items up to a fixed number, so copies stay in proportion to the queries. Each pair of
blocks is one matrix product that passes on at most ``k`` items per query (more
only where scores tie).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from staylens.functions.text import words
from staylens.functions.vectors import HashingEmbedder, has_vector
from staylens.operators.filters import admitted_keys, restrict_key
from staylens.operators.windows import first_per_key, keep_last
from staylens.session import shared_dir, store

# Fixed values of the index and of chunking.
CHUNK_TOKENS = 512
DEFAULT_NEIGHBOURS = 10
LEAF_SIZE = 1000
LEAF_SHARE = 0.05
METRICS = ("cosine", "dot", "euclidean")
RESTRICT_COLUMNS = ("continent", "city", "country", "rating")

# Rows of the blocks of one matrix product.
ITEM_BLOCK, QUERY_BLOCK = 2048, 512
# Salts of a key at most, each for about so many blocks of items.
SALTS, SALT_BLOCKS = 16, 4
# Query blocks whose floors a task remembers; more only cost some pruning.
REMEMBERED_BLOCKS = 1024
# Index: training rows per centre, leaves of one cell, and items that one task assigns at once.
TRAIN_ROWS = 128
CELL_LEAVES = 4096
ASSIGNED_ROWS = 1 << 16

# Scores are compared at this precision, so equal vectors tie whatever order
# the matrix product sums in; ties go to the smaller id.
SCORE_DIGITS = 9


def words_per_chunk(max_tokens: int = CHUNK_TOKENS) -> int:
    """Words after which a chunk is over its budget of four tokens per five words."""
    return -(-(max_tokens + 1) * 5 // 4)


def chunk(df: DataFrame, max_tokens: int = CHUNK_TOKENS, text: str = "review_text") -> DataFrame:
    """One row per chunk of a text with its 0-based ``chunk_index``."""
    size = words_per_chunk(max_tokens)
    kept = [c for c in df.columns if c != text]
    split = df.withColumn("_w", words(F.col(text)))
    starts = F.when(F.size("_w") > 0, F.sequence(F.lit(1), F.size("_w"), F.lit(size)))
    chunks = F.transform(starts, lambda i: F.array_join(F.slice("_w", i, size), " "))
    return split.select(*kept, F.posexplode(chunks).alias("chunk_index", "chunk"))


def vector_docs(chunks: DataFrame, metadata: list[str], id_col: str = "id") -> DataFrame:
    """Index documents: id with chunk number, vector, metadata."""
    return chunks.select(
        F.concat(F.col(id_col).cast("string"), F.lit("_chunk"), "chunk_index").alias("id"),
        F.col("embedding").alias("vector"),
        F.struct(*metadata).alias("metadata"),
    )


def embed(df: DataFrame, fn: HashingEmbedder | Callable[[list[str]], np.ndarray], text: str,
          out: str = "embedding", rows: int = 256) -> DataFrame:
    """Append the vector of a text column.

    An embedder with ``transform`` works on columns; a model given as a function
    gets at most ``rows`` texts per call.
    """
    if hasattr(fn, "transform"):
        return fn.transform(df, text, out)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), rows):
                part = batch.iloc[start : start + rows]
                vectors = np.asarray(fn(part[text].tolist()), dtype="float64")
                yield part[names].assign(**{out: list(vectors)})

    fields = ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)
    return df.mapInPandas(run, f"{fields}, `{out}` array<double>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column without NULLs as a dense matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(column) == 0:
        return flat.reshape(0, 0)
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def _scores(items: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Item x query scores, larger is nearer."""
    if items.shape[1] != queries.shape[1]:
        raise ValueError(f"{items.shape[1]}-dim items, {queries.shape[1]}-dim queries")
    dots = items @ queries.T
    if metric == "dot":
        out = dots
    elif metric == "cosine":
        scale = np.linalg.norm(items, axis=1)[:, None] * np.linalg.norm(queries, axis=1)[None, :]
        out = np.divide(dots, scale, out=np.zeros_like(dots), where=scale > 0)
    else:
        square = (items**2).sum(axis=1)[:, None] + (queries**2).sum(axis=1)[None, :] - 2 * dots
        out = -np.sqrt(np.maximum(square, 0))
    return np.round(out, SCORE_DIGITS)


def _packed(rows: DataFrame, names: dict[str, str], size: int) -> DataFrame:
    """Rows as blocks: key, copies, and each named column as one list (vectors flattened).

    A block holds rows of one key and of one batch, at most ``size``.
    """
    kinds = dict(rows.dtypes)
    lists = ", ".join(f"`{new}` array<{'double' if old == 'embedding' else kinds[old]}>" for old, new in names.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["key"].dictionary_encode()
            order = np.argsort(codes.indices.to_numpy(), kind="stable")
            sorted_codes = codes.indices.to_numpy()[order]
            edges = np.flatnonzero(np.diff(sorted_codes)) + 1
            starts = [
                at for low, high in zip(np.r_[0, edges], np.r_[edges, len(order)], strict=True)
                for at in range(low, high, size)] if len(order) else []
            cuts = np.array([*starts, len(order)])
            picked = batch.take(pa.array(order))
            columns = []
            for old in names:
                column = picked[old]
                if old == "embedding":
                    whole = _matrix(column)
                    values = pa.array(whole.ravel())
                    ends = cuts * (whole.shape[1] if len(whole) else 0)
                else:
                    values, ends = column, cuts
                columns.append(pa.ListArray.from_arrays(pa.array(ends.astype("int32")), values))
            first = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays(
                [picked["key"].take(first), picked["copies"].take(first), *columns], names=["key", "copies", *names.values()])

    return rows.select("key", "copies", *names).mapInArrow(run, f"key string, copies int, {lists}")


def _meet(items: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Exact top ``k`` of every query among the items that share one of its keys.

    ``items``: key, copies, id, embedding, rating; ``queries``: key, copies,
    query_id, embedding, least (the smallest rating, or null). ``copies`` is the
    same in all rows of a key. An item must have at most one row per key of a query.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    id_kind, query_kind = dict(items.dtypes)["id"], dict(queries.dtypes)["query_id"]
    blocks = _packed(items, {"id": "ids", "embedding": "vectors", "rating": "ratings"}, ITEM_BLOCK)
    blocks = blocks.withColumn("salt", F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col("copies")).cast("int"))
    asked = _packed(queries, {"query_id": "query_ids", "embedding": "wanted", "least": "leasts"}, QUERY_BLOCK)
    # A join, as Spark counts the copies in its size; of an explode it would broadcast all copies as if they were one.
    salts = queries.sparkSession.range(SALTS).select(F.col("id").cast("int").alias("salt"))
    asked = asked.join(salts, F.col("salt") < F.col("copies")).drop("copies")
    met = blocks.join(asked, ["key", "salt"]).select("ids", "vectors", "ratings", "query_ids", "wanted", "leasts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Score that an item must reach to enter the best k of a query, as far as this task has seen.
        floors: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, vectors, ratings, query_ids, wanted, leasts = (batch.column(c)[row].values for c in range(6))
                here = vectors.to_numpy().reshape(len(ids), -1)
                there = wanted.to_numpy().reshape(len(query_ids), -1)
                scores = _scores(here, there, metric)
                least = leasts.to_numpy(zero_copy_only=False).astype("float64")
                if not np.isnan(least).all():
                    rating = ratings.to_numpy(zero_copy_only=False).astype("float64")
                    scores[~((rating[:, None] >= least) | np.isnan(least))] = -np.inf
                if len(floors) > REMEMBERED_BLOCKS:
                    floors.clear()
                block = tuple(query_ids[:2].to_pylist()), len(query_ids)
                floor = floors.get(block, np.full(len(query_ids), -np.inf))
                if len(ids) >= k:
                    floor = np.maximum(floor, np.partition(scores, len(ids) - k, axis=0)[len(ids) - k])
                    floors[block] = floor
                at, of = np.nonzero((scores >= floor) & np.isfinite(scores))
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(of)), ids.take(pa.array(at)), pa.array(scores[at, of])],
                    names=["query_id", "id", "score"])

    candidates = met.mapInArrow(run, f"query_id {query_kind}, id {id_kind}, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = candidates.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    value = -F.col("score") if metric == "euclidean" else F.col("score")
    return ranked.select("query_id", "id", value.alias("distance"), "rank")


def _salts(n: Column) -> Column:
    """Salts of a key that holds ``n`` items."""
    return F.greatest(F.lit(1), F.least(F.lit(SALTS), F.ceil(n / (SALT_BLOCKS * ITEM_BLOCK)))).cast("int")


def _copies(items: DataFrame) -> Column:
    return _salts(F.lit(items.count()))


def _items(items: DataFrame, *more: Column) -> DataFrame:
    rating = F.col("rating").cast("double") if "rating" in items.columns else F.lit(None).cast("double")
    return items.filter(has_vector(F.col("embedding"))).select("id", "embedding", rating.alias("rating"), *more)


def _queries(queries: DataFrame, restricted: bool, *more: Column) -> DataFrame:
    """Queries with their restrict key and least rating, which admit all where nothing is restricted."""
    asked = {c: F.col(c) for c in queries.columns}
    return queries.filter(has_vector(F.col("embedding"))).select(
        "query_id", "embedding",
        (F.when(F.col("filter_rating"), F.col("rating").cast("double")) if restricted
         else F.lit(None).cast("double")).alias("least"),
        (restrict_key(asked) if restricted else F.lit("")).alias("key"), *more)


def knn(items: DataFrame, queries: DataFrame, k: int = DEFAULT_NEIGHBOURS, metric: str = "dot") -> DataFrame:
    """Exact top k of every query: ``query_id, id, distance, rank``.

    ``distance`` is the similarity for ``dot`` and ``cosine`` (largest first)
    and the distance for ``euclidean`` (smallest first). Scores are compared at
    nine decimals, ties go to the smaller id. Rows without a vector are left out.
    """
    copies = _copies(items).alias("copies")
    here = _items(items, F.lit("").alias("key"), copies)
    return _meet(here, _queries(queries, False, copies), k, metric)


def knn_filtered(items: DataFrame, queries: DataFrame, k: int = DEFAULT_NEIGHBOURS,
                 metric: str = "dot") -> DataFrame:
    """Exact top k among the items each query's restricts admit.

    Queries carry continent, city, country, rating and the two filter flags. An
    item meets queries under the keys it is admitted by, as far as some query asks for them.
    """
    copies = _copies(items).alias("copies")
    asked = _queries(queries, True, copies)
    here = _items(items, F.explode(admitted_keys({c: F.col(c) for c in items.columns})).alias("key"), copies)
    return _meet(here.join(asked.select("key").distinct(), "key", "left_semi"), asked, k, metric)


class Index(NamedTuple):
    """A stored tree index: items by cell and leaf, leaf centres, and what each leaf admits."""

    items: DataFrame
    leaves: DataFrame
    admits: DataFrame


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _spherical_centres(rows: np.ndarray, n: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a k-means by cosine."""
    rows = np.unique(_unit(rows), axis=0)
    if len(rows) <= n:
        return rows
    centres = rows[np.random.default_rng(seed).choice(len(rows), n, replace=False)]
    for _ in range(rounds):
        near = np.argmax(rows @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(np.bincount(near, minlength=n)[:, None] > 0, _unit(sums), centres)
    return centres


def ann_build(items: DataFrame, folder: str, leaf_size: int = LEAF_SIZE, seed: int = 7) -> Index:
    """Builds and stores a two-level tree of about ``leaf_size`` items per leaf, however many items there are.

    Cells are centres of a k-means on a bounded sample, about the root of the
    number of leaves; each cell is cut into leaves by a k-means of its own in
    its own task. Every item with a vector goes to the nearest cell and then to the nearest
    leaf of that cell; a cell with many items is dealt to several tasks. Items lie
    in one folder per cell, sorted by leaf. Items with restrict columns can be
    searched with restricts: the index knows per leaf which restrict keys occur, and the largest rating of each.
    """
    spark = items.sparkSession
    usable = items.filter(has_vector(F.col("embedding")))
    n = usable.count()
    cells = max(1, round((n / leaf_size) ** 0.5))
    share = min(1.0, TRAIN_ROWS * cells / max(n, 1))
    unit = F.transform("embedding", lambda x: x.cast("double"))
    sample = usable.select(array_to_vector(unit).alias("features"))
    sample = Normalizer(p=2.0, inputCol="features", outputCol="unit").transform(
        sample.sample(share, seed) if share < 1 else sample)
    roots = np.zeros((1, 1))
    if n and cells > 1:
        model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="unit").fit(sample)
        roots = _unit(np.asarray(model.clusterCenters()))

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        if len(roots) == 1 or len(vectors) == 0:
            return pd.Series(np.zeros(len(vectors), "int32"))
        rows = np.stack(vectors.to_numpy()).astype("float64")
        return pd.Series(np.argmax(rows @ roots.T, axis=1).astype("int32"))

    placed = store(usable.withColumn("cell", cell_of("embedding")), f"{folder}/placed")
    # A row per cell: its leaves, and the parts that its items are dealt to.
    sizes = store(placed.groupBy("cell").count().select(
        "cell", F.greatest(F.lit(1), F.least(F.lit(CELL_LEAVES), F.round(F.col("count") / leaf_size))).cast("int").alias("most"),
        F.ceil(F.col("count") / ASSIGNED_ROWS).cast("int").alias("parts")), f"{folder}/cells")
    order = Window.partitionBy("cell").orderBy(F.xxhash64("id"))
    train = placed.select("cell", "embedding", F.row_number().over(order).alias("at")).join(sizes, "cell").where(
        F.col("at") <= F.col("most") * TRAIN_ROWS).select("cell", "most", "embedding")

    def centres_of(part: pa.Table) -> pa.Table:
        cell, most = part["cell"][0].as_py(), part["most"][0].as_py()
        centres = _spherical_centres(_matrix(part["embedding"]), most, seed)
        return pa.table({
            "cell": pa.array([cell] * len(centres), pa.int32()),
            "leaf": pa.array(cell * CELL_LEAVES + np.arange(len(centres)), pa.int64()), "centre": list(centres)})

    centres = store(train.groupBy("cell").applyInArrow(
        centres_of, "cell int, leaf long, centre array<double>"), f"{folder}/centres")
    dealt = placed.join(sizes.select("cell", "parts"), "cell").withColumn(
        "part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    copied = centres.join(sizes.select("cell", "parts"), "cell").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    names = [c for c in dealt.columns if c != "part"]

    def leaf_of(rows: pa.Table, near: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return rows.select(names).append_column("leaf", pa.array([], pa.int64()))
        leaves, best = near["leaf"].to_numpy(), []
        for start in range(0, rows.num_rows, ITEM_BLOCK):
            vectors = _matrix(rows["embedding"].slice(start, ITEM_BLOCK))
            best.append(leaves[np.argmax(vectors @ _matrix(near["centre"]).T, axis=1)])
        return rows.select(names).append_column("leaf", pa.array(np.concatenate(best), pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name != "part")
    assigned = dealt.groupBy("cell", "part").cogroup(copied.groupBy("cell", "part")).applyInArrow(
        leaf_of, f"{fields}, leaf long")
    # Keeps the columns of an index without items.
    store(spark.createDataFrame([], assigned.schema), f"{folder}/columns")
    return _publish(spark, folder, 0, assigned)


def _sums(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items per leaf, and the restrict keys of each leaf with the largest rating."""
    if set(RESTRICT_COLUMNS) <= set(items.columns):
        keys = items.select(
            "leaf", "rating", F.explode(admitted_keys({c: F.col(c) for c in RESTRICT_COLUMNS})).alias("key"))
        keys = keys.groupBy("leaf", "key").agg(F.max("rating").alias("rating"))
    else:
        keys = items.select("leaf").distinct().select(
            "leaf", F.lit("").alias("key"), F.lit(None).cast("double").alias("rating"))
    return items.groupBy("leaf").agg(F.count("*").alias("n")), keys


def _stored_items(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{folder}/columns").schema).parquet(f"{folder}/{name}")


def _manifest(spark: SparkSession, folder: str, version: int, items: str, deltas: list[str],
              counts: DataFrame, keys: DataFrame) -> Index:
    """Writes the leaf tables of a version, then the row that makes the version valid."""
    centres = spark.read.parquet(f"{folder}/centres").join(counts, "leaf").select("leaf", "centre", "n")
    store(centres, f"{folder}/leaves-{version}")
    store(keys, f"{folder}/admits-{version}")
    row = spark.createDataFrame([(items, deltas)], "items string, deltas array<string>")
    row.write.mode("overwrite").parquet(f"{folder}/versions/version={version}")
    return ann_open(spark, folder)


def _publish(spark: SparkSession, folder: str, version: int, assigned: DataFrame) -> Index:
    """Writes items that know their cell and leaf as a version without deltas."""
    name = f"items-{version}"
    assigned.sortWithinPartitions("cell", "leaf").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/{name}")
    return _manifest(spark, folder, version, name, [], *_sums(_stored_items(spark, folder, name)))


def _newest(spark: SparkSession, folder: str):
    return spark.read.parquet(f"{folder}/versions").orderBy(F.desc("version")).first()


def ann_open(spark: SparkSession, folder: str) -> Index:
    """The newest version of a stored index: its items, with the rows of later deltas in their place."""
    now = _newest(spark, folder)
    items = _stored_items(spark, folder, now["items"])
    if now["deltas"]:
        changes = spark.read.parquet(*[f"{folder}/{d}" for d in now["deltas"]])
        last = first_per_key(changes, ["id"], [F.desc("version")])
        items = items.join(changes.select("id").distinct(), "id", "left_anti").unionByName(
            last.filter("not deleted").select(*items.columns))
    leaves, admits = (f"{folder}/{t}-{now['version']}" for t in ("leaves", "admits"))
    return Index(items, spark.read.parquet(leaves), spark.read.parquet(admits))


def ann_upsert(spark: SparkSession, folder: str, delta: DataFrame, pos: str) -> Index:
    """A new version of a stored index in which the delta's rows replace or join those of their id.

    The last row of an id in the order of ``pos`` wins; one without a vector removes the id.
    Only the delta is placed, each row in the leaf of the nearest centre, and written;
    stored items are not touched until ``ann_compact``. Leaf counts and restrict keys may
    still tell of replaced rows: that can cost a needless read, never a hit. Columns
    that the delta lacks are null.
    """
    now = _newest(spark, folder)
    version, name = now["version"] + 1, f"delta-{now['version'] + 1}"
    columns = spark.read.parquet(f"{folder}/columns").schema
    centres = spark.read.parquet(f"{folder}/centres")
    least = centres.agg(F.min("leaf")).first()[0]
    if least is None:
        raise ValueError("an index without leaves takes no deltas")
    # Placed and written from one stored copy, so that both see the same rows.
    last = store(keep_last(delta, ["id"], [pos]), f"{folder}/given-{version}")
    near = knn(centres.select(F.col("leaf").alias("id"), F.col("centre").alias("embedding")),
               last.select(F.col("id").alias("query_id"), "embedding"), 1, "cosine")
    placed = last.drop("cell", "leaf").join(
        near.select(F.col("query_id").alias("id"), F.col("id").alias("leaf")), "id", "left")
    placed = placed.withColumn("leaf", F.coalesce("leaf", F.lit(least)).cast("long"))
    placed = placed.withColumn("cell", F.floor(F.col("leaf") / CELL_LEAVES))
    fields = [
        (F.col(f.name) if f.name in placed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns]
    written = store(placed.select(
        *fields, (~has_vector(F.col("embedding"))).alias("deleted"), F.lit(version).alias("version")), f"{folder}/{name}")
    counts, keys = _sums(written.filter("not deleted"))
    before = [spark.read.parquet(f"{folder}/{t}-{now['version']}") for t in ("leaves", "admits")]
    counts = before[0].select("leaf", "n").unionByName(counts).groupBy("leaf").agg(F.sum("n").alias("n"))
    keys = before[1].unionByName(keys).groupBy("leaf", "key").agg(F.max("rating").alias("rating"))
    return _manifest(spark, folder, version, now["items"], [*now["deltas"], name], counts, keys)


def ann_compact(spark: SparkSession, folder: str) -> Index:
    """A new version with the deltas worked into the items; hits stay the same.

    Files of older versions stay for their readers.
    """
    return _publish(spark, folder, _newest(spark, folder)["version"] + 1, ann_open(spark, folder).items)


def ann_query(index: Index, queries: DataFrame, k: int = DEFAULT_NEIGHBOURS, share: float = LEAF_SHARE,
              min_leaves: int = 1, metric: str = "dot", restricted: bool = False) -> DataFrame:
    """Approximate top k: only the ``share`` of leaves whose centres score best are searched.

    With restricts, the leaves of a query are chosen among those that hold an
    item of its restrict key with a sufficient rating; other leaves are not read.
    Probing all leaves gives the exact result. Routing is a search among the
    leaf centres, so it takes any number of queries and leaves.
    """
    n_leaves = index.leaves.count()
    probes = max(min_leaves, int(np.ceil(share * n_leaves)), 1)
    centres = index.leaves.select(F.col("leaf").alias("id"), F.col("centre").alias("embedding"), "n")
    asked = store(_queries(queries, restricted), shared_dir(queries.sparkSession, "asked"))
    spread = _salts(F.lit(n_leaves))
    if restricted:
        admitted = index.admits.join(asked.select("key").distinct(), "key", "left_semi")
        targets = admitted.join(centres.drop("n"), admitted["leaf"] == centres["id"]).select(
            "id", "embedding", "rating", "key", spread.alias("copies"))
    else:
        targets = _items(centres.drop("n"), F.lit("").alias("key"), spread.alias("copies"))
    # Centres have length one: for cosine and distance the direction decides, too.
    routes = _meet(targets, asked.withColumn("copies", spread), probes, "dot" if metric == "dot" else "cosine")
    sized = index.leaves.select("leaf", _salts(F.col("n")).alias("copies"))
    routes = store(routes.select("query_id", F.col("id").alias("leaf")).join(sized, "leaf"),
                   shared_dir(queries.sparkSession, "routes"))
    inside = F.concat_ws("|", F.col("leaf").cast("string"), "key")
    routed = asked.join(routes, "query_id").withColumn("key", inside).drop("leaf").repartition("key")
    admits = admitted_keys({c: F.col(c) for c in RESTRICT_COLUMNS}) if restricted else F.array(F.lit(""))
    read = index.items.join(routes.select("leaf", "copies").distinct(), "leaf")
    here = _items(read, F.explode(admits).alias("key"), "leaf", "copies").withColumn("key", inside).drop("leaf")
    if restricted:
        here = here.join(routed.select("key").distinct(), "key", "left_semi")
    return _meet(here, routed, k, metric)
