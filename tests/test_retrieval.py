import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from staylens.catalog import base
from staylens.catalog.retrieval import K, shown, sparse, topics
from staylens.functions.vectors import hashing_embedder
from staylens.operators import retrieval, telemetry, vectors
from staylens.operators.registry import Registry, complete_with, default_registries
from staylens.session import shared_dir

RNG = np.random.default_rng(3)
ITEMS = RNG.normal(size=(300, 8)).round(2)
ITEMS[100:200] = ITEMS[0]  # a third of the items are copies of one vector
QUERIES = RNG.normal(size=(7, 8)).round(2)
QUERIES[0] = ITEMS[0]
PLACES = [("Paris", "France", "Europe"), ("Oslo", "Norway", "Europe"), ("Lima", "Peru", "Americas")]


@pytest.fixture(scope="module")
def items(spark):
    data = [(i, v.tolist(), *PLACES[i % 3], None if i % 11 == 0 else float(i % 5)) for i, v in enumerate(ITEMS)]
    data += [(900, [], "Paris", "France", "Europe", 5.0), (901, None, "Oslo", "Norway", "Europe", 5.0)]
    return spark.createDataFrame(
        data, "id long, embedding array<double>, city string, country string, continent string, rating double"
    ).repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    data = [
        (q, v.tolist(), ["", "Europe"][q % 2], "Oslo", "Norway", q % 3, q % 3 > 0, q % 4 == 3)
        for q, v in enumerate(QUERIES)
    ]
    return spark.createDataFrame(
        data, "query_id long, embedding array<double>, continent string, city string, country string, "
        "rating int, filter_rating boolean, filter_city_country boolean"
    )


def brute(metric, k, admits=lambda q, i: True):
    out = []
    for q, query in enumerate(QUERIES):
        scored = []
        for i, item in enumerate(ITEMS):
            if not admits(q, i):
                continue
            if metric == "dot":
                s = item @ query
            elif metric == "cosine":
                s = item @ query / np.linalg.norm(item) / np.linalg.norm(query)
            else:
                s = -np.linalg.norm(item - query)
            scored.append((-round(s, 9), i))
        out += [(q, i, rank + 1) for rank, (_, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("metric", vectors.METRICS)
@pytest.mark.parametrize("item_block, query_block", [(2048, 512), (7, 2)])
def test_knn_equals_brute_force(rows, items, queries, monkeypatch, metric, item_block, query_block):
    monkeypatch.setattr(vectors, "ITEM_BLOCK", item_block)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(vectors, "REMEMBERED_BLOCKS", 1)
    got = vectors.knn(items, queries, 12, metric)
    assert rows(got, "query_id", "id", "rank") == brute(metric, 12)


def admits(q, i):
    city, country, continent = PLACES[i % 3]
    rating = None if i % 11 == 0 else i % 5
    return (
        (q % 2 == 0 or continent == "Europe")
        and (q % 4 != 3 or (city, country) == ("Oslo", "Norway"))
        and (q % 3 == 0 or (rating is not None and rating >= q % 3))
    )


def test_knn_filtered(rows, items, queries):
    got = vectors.knn_filtered(items, queries, 9)
    assert rows(got, "query_id", "id", "rank") == brute("dot", 9, admits)


def test_copies_follow_the_items(spark, rows, items, queries, monkeypatch):
    # Not the shuffle partitions: 200 copies of all query blocks went through the driver as a broadcast.
    salts = lambda: spark.range(1).select(vectors._copies(items)).first()[0]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert salts() == 1
        monkeypatch.setattr(vectors, "ITEM_BLOCK", 7)
        assert salts() == 11
        monkeypatch.setattr(vectors, "SALT_BLOCKS", 1)
        assert salts() == vectors.SALTS
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    got = vectors.knn(items, queries, 12)
    assert rows(got, "query_id", "id", "rank") == brute("dot", 12)
    # The copies are in the size by which Spark chooses a broadcast.
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(got) > size(items) * size(queries) * vectors.SALTS


def test_knn_is_monotone_in_k_and_knows_string_ids(rows, items, queries):
    named = items.withColumn("id", F.format_string("v%03d", "id"))
    small = set(rows(vectors.knn(named, queries, 3), "query_id", "id"))
    large = set(rows(vectors.knn(named, queries, 8), "query_id", "id"))
    assert small < large and len(small) == 21


def test_knn_edges(items, queries):
    assert vectors.knn(items, queries.limit(0), 3).count() == 0
    assert vectors.knn(items.limit(0), queries, 3).count() == 0
    assert vectors.knn(items, queries, 1000).filter("query_id = 1").count() == 300
    with pytest.raises(ValueError, match="unknown metric"):
        vectors.knn(items, queries, 3, "hamming")


def test_ann_recall(spark, rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20] + rng.normal(size=16) * 0.15).tolist()) for i in range(2000)]
    items = spark.createDataFrame(data, "id long, embedding array<double>").repartition(4)
    queries = items.filter("id < 40").withColumnRenamed("id", "query_id")
    index = vectors.ann_build(items, shared_dir(spark, "tree"), leaf_size=100)
    assert index.items.count() == 2000 and 15 <= index.leaves.count() <= 25
    assert rows(index.items, "id") == rows(items, "id")
    exact = set(rows(vectors.knn(items, queries, 10), "query_id", "id"))
    near = set(rows(vectors.ann_query(index, queries, 10, share=0.25), "query_id", "id"))
    assert len(exact & near) / len(exact) >= 0.9
    everything = vectors.ann_query(index, queries, 10, share=1.0)
    assert set(rows(everything, "query_id", "id")) == exact


def test_ann_restricts(spark, rows, items, queries, monkeypatch):
    monkeypatch.setattr(vectors, "ASSIGNED_ROWS", 40)
    folder = shared_dir(spark, "tree")
    vectors.ann_build(items, folder, leaf_size=20)
    index = vectors.ann_open(spark, folder)
    got = vectors.ann_query(index, queries, 9, share=1.0, restricted=True)
    assert rows(got, "query_id", "id", "rank") == brute("dot", 9, admits)
    # A leaf is only searched where it holds an item that is admitted.
    few = vectors.ann_query(index, queries, 9, share=0.1, restricted=True)
    found = rows(few, "query_id", "id")
    assert found and all(admits(q, i) for q, i in found)
    assert {q for q, _ in found} == {q for q, *_ in brute("dot", 9, admits)}


def test_index_deltas(spark, rows, items, queries):
    folder = shared_dir(spark, "tree")
    turned = F.when(F.col("id") % 5 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    surplus = items.filter("id < 20").withColumn("id", F.col("id") + 1000)
    base = items.filter("id < 200").withColumn("embedding", turned).unionByName(surplus)
    vectors.ann_build(base, folder, leaf_size=20)
    right = items.filter("id % 5 = 0 or id >= 200")
    older = right.withColumns({"embedding": F.reverse("embedding"), "pos": F.lit(1)})
    vectors.ann_upsert(spark, folder, right.withColumn("pos", F.lit(2)).unionByName(older), "pos")
    gone = surplus.select("id", F.lit(None).cast("array<double>").alias("embedding"), F.lit(0).alias("pos"))
    vectors.ann_upsert(spark, folder, gone, "pos")
    vectors.ann_upsert(spark, folder, gone.limit(0), "pos")
    want, live = brute("dot", 9, admits), items.filter("size(embedding) > 0")
    for index in (vectors.ann_open(spark, folder), vectors.ann_compact(spark, folder)):
        assert rows(index.items, "id") == rows(live, "id")
        got = vectors.ann_query(index, queries, 9, share=1.0, restricted=True)
        assert rows(got, "query_id", "id", "rank") == want
    assert vectors._newest(spark, folder)["deltas"] == []
    # Deltas go on after a compaction, and an id that was removed may come back.
    index = vectors.ann_upsert(spark, folder, surplus.withColumn("pos", F.lit(0)), "pos")
    assert index.items.count() == live.count() + 20


def test_ann_of_equal_vectors_and_of_nothing(spark, rows):
    data = [(i, [1.0, 0.0] if i % 3 else [float(i), 1.0]) for i in range(300)] + [(999, [0.0, 0.0])]
    items = spark.createDataFrame(data, "id long, embedding array<double>")
    queries = items.filter("id < 5").withColumnRenamed("id", "query_id")
    index = vectors.ann_build(items, shared_dir(spark, "tree"), leaf_size=10)
    assert index.items.count() == 301
    exact = vectors.knn(items, queries, 4)
    assert rows(vectors.ann_query(index, queries, 4, share=1.0)) == rows(exact)
    nothing = vectors.ann_build(items.limit(0), shared_dir(spark, "tree"))
    assert vectors.ann_query(nothing, queries, 4).count() == 0


@pytest.mark.parametrize("n, sizes", [(0, []), (1, [1]), (641, [641]), (642, [642]), (643, [642, 1]), (1284, [642, 642])])
def test_chunk_sizes(spark, n, sizes):
    df = spark.createDataFrame([(1, " \n".join(f"w{i}" for i in range(n)))], "id int, review_text string")
    got = sorted((r.chunk_index, len(r.chunk.split(" "))) for r in vectors.chunk(df).collect())
    assert got == list(enumerate(sizes))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n\t ", max_size=60), st.integers(1, 6))
def test_chunks_join_to_the_text(spark, text, budget):
    df = spark.createDataFrame([(1, text)], "id int, review_text string")
    got = sorted((r.chunk_index, r.chunk) for r in vectors.chunk(df, budget).collect())
    assert " ".join(c for _, c in got) == " ".join(text.split())
    for _, chunk in got:
        assert (len(chunk.split()) - 1) * 4 // 5 <= budget


def test_texts_of_sparse_vectors_are_embedded_and_hashed_once(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "doc_id long, text string")
    out = sparse(vectors.embed(texts, hashing_embedder(), "text"), "doc_id")
    assert [r.id for r in out.collect()] == [1, 1]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    texts.selectExpr("doc_id", "'en' as lang", "'s' as source", "text").write.parquet(f"{tmp_path}/documents.parquet")
    docs = base.QUERIES["v2_vector_docs"](spark, str(tmp_path))
    assert [(r.id, r.weight) for r in docs.orderBy("weight").collect()] == [("1_chunk0", 0.447214), ("1_chunk0", 0.894427)]
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    # Plans are read from below: the chunk is hashed before the vector becomes rows.
    assert plan.count("md5(") == 1 and plan.index("posexplode(vector") < plan.index("sha2(")


def test_index_deltas_make_their_items_once(spark, rows, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    data = [(i, ITEMS[i].tolist(), f"text {i}", i % 3, *PLACES[i % 3], 4.0) for i in range(40)]
    items = spark.createDataFrame(data, "id long, embedding array<float>, review_text string, label int, "
                                        "city string, country string, continent string, rating double")
    t = base.tables_for(spark, str(tmp_path))
    t._made["items"] = items.withColumn("review_text", read("review_text"))
    t._made["embeddings"] = items.select(F.col("id").alias("vec_id"), "embedding", "label")
    got = rows(base.QUERIES["k7_index_deltas"](spark, str(tmp_path)), "query_id", "id", "distance", "rank")
    assert seen.value == 40
    assert got == rows(shown(vectors.knn(items, topics(t), K)), "query_id", "id", "distance", "rank")


def test_embed_passes_bounded_batches(spark):
    def fn(texts):
        assert len(texts) <= 3
        return np.ones((len(texts), 2)) * len(texts)

    df = spark.createDataFrame([(i, "x") for i in range(10)], "id int, t string").coalesce(1)
    assert vectors.embed(df, fn, "t", rows=3).filter("size(embedding) = 2").count() == 10


def test_resolve_attempts(spark):
    log = [
        (1, 0, 1, "gemini", False, None, "Error 429"), (1, 1, 2, "grok", True, "yes", None),
        (1, 2, 3, "openai", True, "late", None),
        (2, 0, 1, "gemini", False, None, "bad key"), (2, 1, 2, "grok", True, "never", None),
        (3, 0, 1, "gemini", False, None, "timeout"), (3, 1, 2, "grok", False, None, "Unavailable"),
        (4, 0, 2, "gemini", False, None, "x"), (4, 0, 1, "gemini", True, "first", None),
    ]
    df = spark.createDataFrame(
        log, "query_id int, chain_pos int, attempt_no int, provider string, ok boolean, content string, error string"
    )
    got = {r.query_id: r for r in retrieval.resolve_attempts(df).collect()}
    assert (got[1].provider, got[1].content, got[1].error) == ("grok", "yes", None)
    assert (got[2].ok, got[2].error) == (False, "all completion providers failed: gemini: bad key")
    assert got[3].error == "all completion providers failed: gemini: timeout | grok: Unavailable"
    assert got[4].content == "first"


def test_chain_and_retryable(spark, rows):
    df = spark.createDataFrame([(1, "grok"), (2, " OPENAI "), (3, "auto"), (4, None), (5, "other")], "q int, preferred_model string")
    got = dict(rows(retrieval.resolve_chain(df, ["gemini", "openai"], "openai"), "q", "chain"))
    assert got == {1: ["gemini", "openai"], 2: ["openai", "gemini"], 3: ["openai", "gemini"],
                   4: ["openai", "gemini"], 5: ["gemini", "openai"]}
    errors = spark.createDataFrame([("Rate Limit hit",), ("bad key",), (None,)], "e string")
    assert [r[0] for r in errors.select(retrieval.is_retryable(F.col("e"))).collect()] == [True, False, False]


@pytest.fixture(scope="module")
def index(spark):
    texts = ["quiet rooms near the park", "loud bar but great spaghetti", "spaghetti and quiet garden", "no"]
    items = spark.createDataFrame(
        [(i, t, f"H{i % 2}", *PLACES[i % 3], 4.5, "me", "", None if i == 2 else "places/1") for i, t in enumerate(texts)],
        "id long, review_text string, hotel_name string, city string, country string, continent string, "
        "rating double, reviewer_name string, google_maps_uri string, photo_name string",
    )
    hotels = spark.createDataFrame(
        [("H0", "2", "Second"), ("H0", "1", "First"), ("H1", "3", None)],
        "name string, source_hotel_id string, street_address string",
    )
    return vectors.embed(items, hashing_embedder(4096), "review_text"), hotels


def test_search_end_to_end(spark, index):
    items, hotels = index
    forms = spark.createDataFrame(
        [(1, "great spaghetti", "", "", "", ""), (2, "drop tables", "", "", "", ""), (3, "quiet", "Asia", "", "", "")],
        "query_id long, question string, continent string, citycountry string, rating string, llm string",
    )

    def judge(asked):
        verdict = F.when(F.col("question").contains("drop"), " No").otherwise("YES.")
        return asked.select("query_id", verdict.alias("answer"))

    calls = spark.sparkContext.accumulator(0)

    def respond(prompts):
        calls.add(len(prompts))
        return [answer] * len(prompts)

    answer = '```json\n[{"Hotel":"H1","City":"Oslo","Rating":5,"photo_name":"places/1"}]\n```'
    out = retrieval.search(
        forms, items, hotels, hashing_embedder(4096), judge,
        complete_with(respond, "prompt", "content"), "dflt", "Header.", "KEY", 2,
    )
    hits = [(r.query_id, r.id, r.street_address) for r in out["hits"].orderBy("query_id", "rank").collect()]
    # Namesake hotels: the smallest hotel id gives the address.
    assert hits == [(1, 1, None), (1, 2, "First")]
    prompt = out["prompts"].head().prompt
    assert prompt.startswith("Header.\n\nUser Question: great spaghetti\n\nImportant: ")
    assert "Review 1:\nHotel: H1\nCity: Oslo\nReview: loud bar" in prompt
    assert "Rating: 4.5\n" in prompt and "Address: <nil>\n" in prompt and prompt.endswith("PhotoName: <nil>\n\n")
    row = out["rows"].head()
    assert row.photo_thumb.endswith("places/1/media?maxWidthPx=120&key=KEY") and row.map_url is None
    status = {r.query_id: r for r in out["status"].collect()}
    assert (status[1].result_count, status[1].mean_rating, status[1].message) == (1, 5.0, "")
    assert (status[2].safe, status[2].result_count) == (False, 0) and "flagged" in status[2].message
    assert (status[3].safe, status[3].result_count, status[3].parse_failed) == (True, 0, False)
    # However often the results are read, the model answered one question once.
    assert calls.value == 1

    chained = retrieval.search(
        forms, items, hotels, hashing_embedder(4096), judge,
        {"gemini": stub("'timeout'"), "grok": stub("cast(null as string)", answer, completion_tokens=5)},
        "dflt", "Header.", "KEY", 2)
    told = {r.query_id: r for r in chained["status"].collect()}
    assert (told[1].model, told[1].completion_tokens, told[1].vector_count, told[1].result_count) == ("grok", 5, 2, 1)
    assert (told[2].model, told[2].vector_count, told[3].model, told[3].error) == (None, 0, None, None)
    assert chained["attempts"].count() == 2
    used = telemetry.recorded_tokens(chained["usage"]).filter("type = 'completion'").collect()
    assert [(r.model, r.value) for r in used] == [("grok", 5.0)]

    down = {"gemini": stub("'refused'"), "grok": stub("cast(null as string)")}
    failed = retrieval.search(
        forms, items, hotels, hashing_embedder(4096), judge, down, "dflt", "Header.", "KEY", 2)
    told = {r.query_id: r for r in failed["status"].collect()}
    assert told[1].error == "all completion providers failed: gemini: refused" and not told[1].parse_failed
    assert failed["rows"].count() == 0 and failed["usage"].count() == 0


def stub(error, content="[]", **more):
    def complete(asked):
        out = asked.select("query_id", F.expr(error).alias("error"))
        out = out.withColumn("content", F.when(F.col("error").isNull(), F.lit(content)))
        return out.withColumns({c: F.lit(v) for c, v in more.items()})
    return complete


def test_complete_chain(spark, tmp_path):
    asked = spark.createDataFrame(
        [(1, "q", "p", "grok"), (2, "q", "p", ""), (3, "q", "p", None), (4, "q", "p", " OpenAI "), (5, "q", "p", "x")],
        "query_id long, question string, prompt string, preferred_model string")
    seen = spark.sparkContext.accumulator(0)
    once = complete_with(lambda xs: seen.add(len(xs)) or [None] * len(xs), "prompt", "content")
    providers = {
        "gemini": stub("case when query_id = 2 then 'invalid key' when query_id = 3 then 'TIMEOUT' "
                       "when query_id = 5 then 'HTTP 429' end", "g", prompt_tokens=7),
        "grok": once, "openai": stub("case when query_id = 5 then 'refused' end", "o"),
    }
    outcomes, attempts = retrieval.complete_chain(asked, providers, str(tmp_path))
    got = {r.query_id: (r.ok, r.provider, r.content, r.prompt_tokens, r.error) for r in outcomes.collect()}
    assert got == {
        1: (True, "gemini", "g", 7, None),
        2: (False, None, None, None, "all completion providers failed: gemini: invalid key"),
        3: (True, "openai", "o", None, None), 4: (True, "openai", "o", None, None),
        5: (False, None, None, None, "all completion providers failed: gemini: HTTP 429 | "
            "grok: unavailable: no answer | openai: refused"),
    }
    outcomes.count()
    # Query 1 first, 3 and 5 as the second step; 2 is closed, 4 answered.
    assert seen.value == 3
    tried = sorted((r.query_id, r.chain_pos, r.provider) for r in attempts.collect())
    assert tried == [(1, 0, "grok"), (1, 1, "gemini"), (2, 0, "gemini"), (3, 0, "gemini"), (3, 1, "grok"),
                     (3, 2, "openai"), (4, 0, "openai"), (5, 0, "gemini"), (5, 1, "grok"), (5, 2, "openai")]
    assert retrieval.complete_chain(asked.limit(0), providers, str(tmp_path / "none"))[0].count() == 0
    for wrong in ({}, {"other": once}):
        with pytest.raises(ValueError):
            retrieval.complete_chain(asked, wrong, str(tmp_path / "wrong"))


def test_registry():
    r = Registry("embedder")
    r.register("a", len)
    r.register("b", len, enabled=False)
    assert r.enabled() == ["a"] and r.get("a") is len
    with pytest.raises(ValueError):
        r.register("a", len)
    with pytest.raises(ValueError):
        r.get("b")
    with pytest.raises(KeyError):
        r.get("c")
    assert "google" in default_registries()["hotels"].enabled()
