"""Chunking, embedding, vector search, prompts and answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from staylens.catalog.base import query
from staylens.catalog.tables import DERIVED, MODELS, WHITE, Tables, trimmed
from staylens.functions.vectors import hashing_embedder, l2_normalise, mean_vectors
from staylens.operators import filters, joins, retrieval, vectors
from staylens.operators.registry import complete_with, default_registries
from staylens.session import shared_dir, store

QUESTION = "quiet hotels"
MODEL = "gemini"
HEADER = "You are a hotel guide."
K = 10

DERIVED.update({
    # Attempts of completion calls: every event is one attempt of a query.
    "attempts": """
        select cast(floor(event_id / 3) as bigint) as query_id, cast(event_id % 3 as int) as chain_pos,
            event_id as attempt_no, 'provider_' || event_id % 3 as provider,
            event_type in ('signup', 'view') as ok,
            case when event_type in ('signup', 'view') then 'answer ' || event_id end as content,
            case event_type when 'error' then 'HTTP 429: slow down' when 'click' then 'Request Timeout'
                when 'purchase' then 'invalid key' end as error
        from {events}""",
    "verdicts": """
        select conv_id * 1000 + turn as query_id,
            case turn % 4 when 0 then ' YES. ' when 1 then 'NO' when 2 then 'Yes, it is' end as answer,
            text as content
        from {conversations}""",
})

WORDS = "list_filter(string_split_regex({}, '" + WHITE + "+'), lambda w: w <> '')"


def words(x: str) -> str:
    return WORDS.replace("{}", x)


# One query per label: the mean vector of its items, restricted in different ways.
MODELS["topics"] = """
    select label as query_id, list(m order by pos) as v,
        case when label % 3 = 0 then (select min(continent) from {items} i where i.label = t.label)
            else '' end as continent,
        label % 4 = 1 as filter_city_country,
        (select min(city) from {items} i where i.label = t.label) as city,
        (select min(country) from {items} i where i.label = t.label) as country,
        label % 2 = 1 as filter_rating, 3 as rating
    from (select label, pos, avg(embedding[pos]) as m from {embeddings},
        (select unnest(range(1, 65)) as pos) group by 1, 2) t group by label"""
MODELS["scored"] = """
    select q.query_id, i.id, q.continent as q_continent, q.filter_city_country, q.city as q_city,
        q.country as q_country, q.filter_rating, q.rating as q_rating, i.continent, i.city,
        i.country, i.rating,
        round(list_dot_product(cast(i.embedding as double[]), q.v), 9) as dot,
        round(list_cosine_similarity(cast(i.embedding as double[]), q.v), 9) as cosine,
        round(list_distance(cast(i.embedding as double[]), q.v), 9) as euclidean
    from {items} i, {topics} q"""


def topics(t: Tables) -> DataFrame:
    """One search query per label of the vectors."""
    means = mean_vectors(t.embeddings, "label")
    place = t.items.groupBy("label").agg(
        F.min("continent").alias("continent"), F.min("city").alias("city"),
        F.min("country").alias("country"),
    )
    label = F.col("label")
    return means.join(place, "label").select(
        label.alias("query_id"), "embedding",
        F.when(label % 3 == 0, F.col("continent")).otherwise("").alias("continent"),
        (label % 4 == 1).alias("filter_city_country"), "city", "country",
        (label % 2 == 1).alias("filter_rating"), F.lit(3).alias("rating"),
    )


def shown(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


def top(score: str, where: str = "true", k: int = K) -> str:
    order = f"{score}, id" if score == "euclidean" else f"{score} desc, id"
    return f"""
        select query_id, id, round({score}, 6) as distance,
            cast(row_number() over (partition by query_id order by {order}) as int) as rank
        from {{scored}} where {where}
        qualify row_number() over (partition by query_id order by {order}) <= {k}"""


RESTRICTS = """(q_continent = '' or continent = q_continent)
    and (not filter_city_country or (city = q_city and country = q_country))
    and (not filter_rating or rating >= q_rating)"""


CHUNKS = f"""
    select doc_id, cast(c as int) as chunk_index,
        array_to_string(w[c * 642 + 1 : (c + 1) * 642], ' ') as chunk
    from (select doc_id, {words('text')} as w from {{documents}}) d,
        unnest(range(0, (len(w) + 641) // 642)) as r(c)"""


@query("v1_chunk", CHUNKS)
def _(t: Tables):
    return vectors.chunk(t.documents.select("doc_id", "text"), text="text")


HASHED = f"""
    bucketed as (select id, ('0x' || substr(md5(lower(w)), 1, 8))::bigint % 64 as bucket,
            count(*) as n from texts, unnest({words('body')}) as u(w) group by 1, 2),
    weights as (select id, bucket, n / sqrt(sum(n * n) over (partition by id)) as weight
        from bucketed)"""


def sparse(df: DataFrame, id_col: str, vector: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """Non-zero weights of vectors, one per row.

    Outer, as Spark puts a filter on the vector's size before an inner explode and embeds every text twice for it.
    """
    each = df.select(F.col(id_col).alias("id"), *carry, F.posexplode_outer(vector).alias("bucket", "weight"))
    return each.filter("weight <> 0").select("id", *carry, "bucket", F.round("weight", 6).alias("weight"))


@query("v2_vector_docs", f"""
    with chunks as (
        select doc_id || '_chunk' || chunk_index as id, lang, source, chunk, chunk as body
        from ({CHUNKS}) join (select doc_id, lang, source from {{documents}}) using (doc_id)),
    texts as (select id, body from chunks), {HASHED}
    select c.id, c.lang, c.source, sha256(c.chunk) as chunk_hash,
        cast(w.bucket as int) as bucket, round(w.weight, 6) as weight
    from chunks c join weights w on w.id = c.id""")
def _(t: Tables):
    chunks = vectors.chunk(t.documents.select("doc_id", "lang", "source", "text"), text="text")
    embedded = vectors.embed(chunks, hashing_embedder(), "chunk")
    docs = vectors.vector_docs(embedded, ["lang", "source", "chunk"], "doc_id")
    # The chunk is hashed once, before its vector becomes a row per weight.
    hashed = docs.select(
        "id", "metadata.lang", "metadata.source", F.sha2("metadata.chunk", 256).alias("chunk_hash"), "vector")
    return sparse(hashed, "id", "vector", ("lang", "source", "chunk_hash"))


@query("v3_embed", f"""
    with texts as (select doc_id as id, text as body from {{documents}}), {HASHED}
    select id, cast(bucket as int) as bucket, round(weight, 6) as weight from weights""")
def _(t: Tables):
    return sparse(vectors.embed(t.documents, hashing_embedder(), "text"), "doc_id")


@query("j13_attach_embedding", f"""
    with texts as (select doc_id as id, text as body from {{documents}}), {HASHED}
    select d.doc_id, d.lang, d.n_chars, cast(64 as int) as dim, count(w.bucket) as used,
        round(max(w.weight), 6) as largest
    from {{documents}} d left join weights w on w.id = d.doc_id group by 1, 2, 3""")
def _(t: Tables):
    out = vectors.embed(t.documents, hashing_embedder(), "text")
    used = F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint")
    largest = F.round(F.array_max("embedding"), 6)
    return out.select(
        "doc_id", "lang", "n_chars", F.size("embedding").alias("dim"), used.alias("used"),
        F.when(largest > 0, largest).alias("largest"))


@query("x4_embedder", f"""
    with texts as (select conv_id * 1000 + turn as id, text as body from {{conversations}}), {HASHED}
    select id, cast(bucket as int) as bucket, round(weight, 6) as weight from weights""")
def _(t: Tables):
    turns = t.conversations.selectExpr("conv_id * 1000 + turn as id", "text")
    embedder = default_registries()["embedders"].get("hashing")
    return sparse(vectors.embed(turns, embedder, "text"), "id")


@query("v4_knn_dot", top("dot"))
def _(t: Tables):
    return shown(vectors.knn(t.items, topics(t), K))


@query("v5_l2_normalise", """
    select vec_id, cast(pos as int) as pos,
        round(cast(embedding[pos + 1] as double) * 3
            / sqrt(list_sum(list_transform(embedding, lambda x: 9 * cast(x as double) * x))), 6) as value
    from {embeddings}, (select unnest(range(0, 64)) as pos) p""")
def _(t: Tables):
    scaled = t.embeddings.select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding")
    )
    unit = l2_normalise(scaled).select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return unit.withColumn("value", F.round("value", 6))


@query("v6_knn_cosine", top("cosine"))
def _(t: Tables):
    return shown(vectors.knn(t.items, topics(t), K, metric="cosine"))


@query("v6_knn_euclidean", top("euclidean"))
def _(t: Tables):
    return shown(vectors.knn(t.items, topics(t), K, metric="euclidean"))


@query("v7_knn_filtered", top("dot", RESTRICTS))
def _(t: Tables):
    return shown(vectors.knn_filtered(t.items, topics(t), K))


@query("o6_top_k", top("dot", k=15))
def _(t: Tables):
    return shown(vectors.knn(t.items, topics(t), 15))


@query("f13_restrict", f"""
    select query_id, count(*) as admitted from {{scored}} where {RESTRICTS} group by 1""")
def _(t: Tables):
    # Items with equal restrict columns are counted once; each kind then meets the queries by key.
    kinds = t.items.groupBy(*vectors.RESTRICT_COLUMNS).agg(F.count("*").alias("n"))
    kinds = kinds.select(
        "n", F.col("rating").alias("has"),
        F.explode(filters.admitted_keys({c: F.col(c) for c in vectors.RESTRICT_COLUMNS})).alias("key"))
    asked = topics(t).drop("embedding")
    asked = asked.withColumn("key", filters.restrict_key({c: F.col(c) for c in asked.columns}))
    joined = kinds.join(asked, "key").where(~F.col("filter_rating") | (F.col("has") >= F.col("rating")))
    return joined.groupBy("query_id").agg(F.sum("n").alias("admitted"))


def index_of(t: Tables) -> vectors.Index:
    return vectors.ann_build(t.items, shared_dir(t.spark, "tree"), leaf_size=25)


@query("v8_ann_query")
def _(t: Tables):
    return shown(vectors.ann_query(index_of(t), topics(t), K, share=0.2))


@query("v8_ann_all_leaves", top("dot"))
def _(t: Tables):
    return shown(vectors.ann_query(index_of(t), topics(t), K, share=1.0))


@query("v8_ann_restricted", top("dot", RESTRICTS))
def _(t: Tables):
    return shown(vectors.ann_query(index_of(t), topics(t), K, share=1.0, restricted=True))


@query("k7_index_deltas", top("dot"))
def _(t: Tables):
    folder = shared_dir(t.spark, "tree")
    turned = F.when(F.col("id") % 5 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))
    # The join that makes the items moves all texts, so it runs once for the four readers.
    items = store(t.items, shared_dir(t.spark, "items"))
    surplus = items.withColumn("id", -1 - F.col("id"))
    vectors.ann_build(items.filter("id % 7 <> 0").withColumn("embedding", turned).unionByName(surplus), folder, 25)
    # Vectors that were wrong or absent, then rows that must go.
    vectors.ann_upsert(t.spark, folder, items.filter("id % 5 = 0 or id % 7 = 0").withColumn("pos", F.lit(0)), "pos")
    gone = surplus.withColumns({"embedding": F.lit(None).cast("array<float>"), "pos": F.lit(0)})
    vectors.ann_upsert(t.spark, folder, gone, "pos")
    return shown(vectors.ann_query(vectors.ann_compact(t.spark, folder), topics(t), K, share=1.0))


@query("v8_ann_recall", """
    select count(distinct query_id) as queries, true as recall_reached from {scored}""")
def _(t: Tables):
    # The share of the exact hits that a search of three quarters of the leaves finds; the given vectors hardly cluster.
    found = vectors.ann_query(index_of(t), topics(t), K, share=0.75).select("query_id", "id", F.lit(1).alias("hit"))
    exact = vectors.knn(t.items, topics(t), K).select("query_id", "id")
    return exact.join(found, ["query_id", "id"], "left").agg(
        F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


HYDRATED = f"""
    hits as ({top('dot', RESTRICTS)}),
    found as (select t.query_id, t.rank, t.id, t.distance, i.review_text, i.hotel_name, i.city,
            i.rating, i.google_maps_uri, i.photo_name, h.street_address
        from hits t join {{items}} i on i.id = t.id
        join {{all_hotels_named}} h on h.name = i.hotel_name
        qualify row_number() over (partition by t.query_id, t.rank order by h.source_hotel_id) = 1)"""
# Two tables of hotels share their names, so a hit meets several addresses.
DERIVED["all_hotels_named"] = """
    select name, source_hotel_id, street_address from {hotels_a}
    union all select name, '0' || source_hotel_id, 'Old ' || street_address from {hotels_a}"""


def found(t: Tables) -> DataFrame:
    hits = vectors.knn_filtered(t.items, topics(t), K)
    return retrieval.hydrate_hits(shown(hits), t.items, t.all_hotels_named)


@query("v9_hydrate_hits", f"""
    with {HYDRATED} select query_id, rank, id, distance, hotel_name, city, rating, street_address
    from found""")
def _(t: Tables):
    return found(t).select(
        "query_id", "rank", "id", "distance", "hotel_name", "city", "rating", "street_address"
    )


@query("j10_attach_rank", """
    with hits as (select user_id as query_id, value as distance,
            case when event_id % 9 = 0 then 'x' else cast(event_id % 700 as string) end as id,
            cast(row_number() over (partition by user_id order by value desc, event_id) as int) as rank
        from {events})
    select h.query_id, h.rank, h.distance, i.id, i.source_hotel_id, i.name
    from hits h join {hotels_a} i on i.id = try_cast(h.id as bigint)""")
def _(t: Tables):
    ranked = joins_ranked(t)
    meta = t.hotels_a.select("id", "source_hotel_id", "name")
    return joins.attach_rank(ranked, meta).select(
        "query_id", "rank", "distance", "id", "source_hotel_id", "name"
    )


def joins_ranked(t: Tables) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    text = F.when(F.col("event_id") % 9 == 0, "x").otherwise(
        (F.col("event_id") % 700).cast("string")
    )
    return t.events.select(
        F.col("user_id").alias("query_id"), F.col("value").alias("distance"), text.alias("id"),
        F.row_number().over(order).alias("rank"),
    )


PROMPTS = f"""
    select query_id, 'topic ' || query_id as question, '{HEADER}' || chr(10) || chr(10)
        || 'User Question: topic ' || query_id || chr(10) || chr(10)
        || '{retrieval.PROMPT_NOTE}' || chr(10) || chr(10) || 'Reviews:' || chr(10)
        || string_agg('Review ' || rank || ':' || chr(10) || 'Hotel: ' || hotel_name || chr(10)
            || 'City: ' || city || chr(10) || 'Review: ' || review_text || chr(10)
            || 'Rating: ' || cast(rating as bigint) || chr(10)
            || 'Distance: ' || printf('%.3f', distance) || chr(10)
            || 'Address: ' || coalesce(street_address, '<nil>') || chr(10)
            || 'GoogleMapsURI: ' || google_maps_uri || chr(10)
            || 'PhotoName: ' || photo_name || chr(10) || chr(10), '' order by rank) as prompt
    from found group by query_id"""


@query("v10_build_prompts", f"with {HYDRATED} {PROMPTS}")
def _(t: Tables):
    asked = topics(t).select(
        "query_id", F.concat(F.lit("topic "), "query_id").alias("question")
    )
    return retrieval.build_prompts(asked, found(t), HEADER)


@query("v11_resolve_chain", f"""
    with asked as (select query_id, lower({trimmed('llm')}) as m from {{forms}})
    select query_id, case when m = 'grok' then 'grok gemini' when m = 'openai' then 'gemini grok'
        else 'gemini grok' end as chain from asked""")
def _(t: Tables):
    chained = retrieval.resolve_chain(t.forms, ["gemini", "grok"], MODEL, col="llm")
    return chained.select("query_id", F.array_join("chain", " ").alias("chain"))


@query("v12_resolve_attempts", """
    with judged as (select *, ok or not coalesce(lower(error) like '%429%'
            or lower(error) like '%timeout%', false) as ends from {attempts}),
    lasts as (select query_id, coalesce(min(chain_pos) filter (where ends), max(chain_pos)) as last
        from judged group by 1)
    select j.query_id, bool_or(j.ok and j.chain_pos = l.last) as ok,
        max(j.provider) filter (where j.ok and j.chain_pos = l.last) as provider,
        max(j.content) filter (where j.ok and j.chain_pos = l.last) as content,
        case when not bool_or(j.ok and j.chain_pos = l.last) then 'all completion providers failed: '
            || string_agg(j.provider || ': ' || coalesce(j.error, ''), ' | ' order by j.chain_pos)
                filter (where j.chain_pos <= l.last) end as error
    from judged j join lasts l on l.query_id = j.query_id group by j.query_id""")
def _(t: Tables):
    return retrieval.resolve_attempts(t.attempts)


def provider(name: str, failing: str):
    """Offline stand-in for a completion provider that fails for some queries."""

    def complete(asked: DataFrame) -> DataFrame:
        error = F.expr(failing)
        return asked.select(
            "query_id", error.alias("error"),
            F.when(error.isNull(), F.concat(F.lit(f"{name}: "), "prompt")).alias("content"),
            F.length("prompt").alias("prompt_tokens"),
            (F.col("query_id") % 100).alias("completion_tokens"))

    return complete


PROVIDERS = {
    "gemini": provider(
        "gemini", "case when query_id % 3 = 0 then 'HTTP 429' when query_id % 5 = 0 then 'invalid key' end"),
    "grok": provider("grok", "case when query_id % 2 = 0 then 'Request Timeout' end"),
    "openai": provider("openai", "case when query_id % 7 = 0 then 'bad request' end"),
}


@query("v12_complete_chain", f"""
    with asked as (select query_id, trim(question) as prompt, lower({trimmed('llm')}) as m from {{forms}}),
    chains as (select query_id, prompt, unnest(case m when 'grok' then ['grok', 'gemini', 'openai']
            when 'openai' then ['openai', 'gemini', 'grok'] else ['gemini', 'grok', 'openai'] end) as provider,
        unnest([0, 1, 2]) as pos from asked),
    tried as (select *, case provider
            when 'gemini' then case when query_id % 3 = 0 then 'HTTP 429' when query_id % 5 = 0 then 'invalid key' end
            when 'grok' then case when query_id % 2 = 0 then 'Request Timeout' end
            else case when query_id % 7 = 0 then 'bad request' end end as error from chains),
    lasts as (select query_id, coalesce(min(pos) filter (where error is null
        or error in ('invalid key', 'bad request')), 2) as last from tried group by 1)
    select t.query_id, cast(last + 1 as bigint) as calls, bool_or(pos = last and error is null) as ok,
        max(provider) filter (where pos = last and error is null) as provider,
        max(provider || ': ' || prompt) filter (where pos = last and error is null) as content,
        max(cast(length(prompt) as bigint)) filter (where pos = last and error is null) as prompt_tokens,
        max(t.query_id % 100) filter (where pos = last and error is null) as completion_tokens,
        case when not bool_or(pos = last and error is null) then 'all completion providers failed: '
            || string_agg(provider || ': ' || error, ' | ' order by pos) filter (where pos <= last) end as error
    from tried t join lasts l on l.query_id = t.query_id group by t.query_id, last""")
def _(t: Tables):
    asked = t.forms.select("query_id", "question", F.trim("question").alias("prompt"), "llm")
    outcomes, attempts = retrieval.complete_chain(
        asked, PROVIDERS, shared_dir(t.spark, "chain"), MODEL, col="llm")
    calls = attempts.groupBy("query_id").agg(F.count("*").alias("calls"))
    return outcomes.join(calls, "query_id")


@query("v13_is_retryable", """
    select event_id, event_type in ('error', 'click') as retryable from {events}""")
def _(t: Tables):
    message = F.when(F.col("event_type") == "error", "RESOURCE EXHAUSTED (quota)").when(
        F.col("event_type") == "click", "service temporarily down"
    ).when(F.col("event_type") == "view", "invalid argument")
    return t.events.select("event_id", retrieval.is_retryable(message).alias("retryable"))


@query("v14_enrich_media", """
    select id, google_maps_uri as map_url,
        case when photo_name <> '' then 'https://places.googleapis.com/v1/' || photo_name
            || '/media?maxWidthPx=120&key=K' end as photo_thumb,
        case when photo_name <> '' then 'https://places.googleapis.com/v1/' || photo_name
            || '/media?maxWidthPx=800&key=K' end as photo_full
    from {reviews}""")
def _(t: Tables):
    return retrieval.enrich_media(t.reviews, "K").select("id", "map_url", "photo_thumb", "photo_full")


FORMS = f"""
    inputs as (select query_id,
            case when question = '' then '{QUESTION}' else {trimmed('question')} end as question,
            {trimmed('continent')} as continent,
            case when contains(citycountry, ',') then trim(split_part(citycountry, ',', 1)) else '' end
                as city,
            case when contains(citycountry, ',') then trim(split_part(citycountry, ',', 2)) else '' end
                as country,
            case when rating = ' 3 ' then 3 else 0 end as rating, rating = ' 3 ' as filter_rating,
            contains(citycountry, ',') as filter_city_country,
            case when llm = '' or lower(trim(llm)) = 'auto' then '{MODEL}' else llm end
                as preferred_model
        from {{forms}})"""


@query("f14_normalise_queries", f"with {FORMS} select * from inputs")
def _(t: Tables):
    return filters.normalise_queries(t.forms, QUESTION, MODEL)


@query("f16_safety_flag", """
    select query_id, coalesce(lower(answer) like '%yes%', false) as safe from {verdicts}""")
def _(t: Tables):
    return filters.safety_flag(t.verdicts).select("query_id", "safe")


@query("f17_apply_safety", f"""
    select query_id, case when coalesce(lower(answer) like '%yes%', false) then content end as content,
        case when coalesce(lower(answer) like '%yes%', false) then ''
            else '{filters.UNSAFE_MESSAGE}' end as message
    from {{verdicts}}""")
def _(t: Tables):
    return filters.apply_safety(filters.safety_flag(t.verdicts)).select("query_id", "content", "message")


@query("f18_non_empty_vectors", "select vec_id from {embeddings} where label <> 2")
def _(t: Tables):
    emptied = F.when(F.col("label") == 2, F.slice("embedding", 1, 0)).otherwise(F.col("embedding"))
    spoiled = t.embeddings.select("vec_id", emptied.alias("embedding"))
    return filters.non_empty_vectors(spoiled).select("vec_id")


def judge(asked: DataFrame) -> DataFrame:
    """Offline stand-in for the safety model: questions with a full stop are fine."""
    answer = F.when(F.col("question").contains("."), "Yes").otherwise("No")
    return asked.select("query_id", answer.alias("answer"))


def write_answer(prompts: list[str]) -> list[str]:
    """Offline stand-in for the completion model: the hotels named in the prompt, as JSON."""
    answers = []
    for prompt in prompts:
        named = [line[7:] for line in prompt.splitlines() if line.startswith("Hotel: ")]
        cities = [line[6:] for line in prompt.splitlines() if line.startswith("City: ")]
        items = [
            {"Hotel": h, "City": c, "Review": "r", "Rating": 4, "Distance": 0.5, "Address": "a"}
            for h, c in zip(named, cities)
        ]
        answers.append("```json\n" + json.dumps(items) + "\n```")
    return answers


def search_all(t: Tables) -> dict[str, DataFrame]:
    """Every user turn as a search over the documents that have a given vector."""
    embedder = hashing_embedder()
    items = vectors.embed(t.items.drop("embedding"), embedder, "review_text")
    # The index is built and stored once, then searched.
    items = store(items, shared_dir(t.spark, "index"))
    return retrieval.search(
        t.forms, items, t.all_hotels_named, embedder, judge,
        complete_with(write_answer, "prompt", "content"), QUESTION, HEADER, k=K,
    )


SEARCH_HITS = f"""
    {FORMS},
    safe as (select * from inputs where contains(question, '.')),
    texts as (select 'q' || query_id as id, question as body from safe
        union all select 'i' || id, review_text from {{items}}), {HASHED},
    dots as (select q.id as qid, i.id as iid, round(sum(q.weight * i.weight), 9) as score
        from weights q join weights i on i.bucket = q.bucket
        where q.id like 'q%' and i.id like 'i%' group by 1, 2),
    ranked as (select s.query_id, i.id, i.hotel_name, coalesce(d.score, 0.0) as score,
            row_number() over (partition by s.query_id order by coalesce(d.score, 0.0) desc, i.id) as rank
        from safe s join {{items}} i on (s.continent = '' or i.continent = s.continent)
            and (not s.filter_city_country or (i.city = s.city and i.country = s.country))
            and (not s.filter_rating or i.rating >= s.rating)
        left join dots d on d.qid = 'q' || s.query_id and d.iid = 'i' || i.id),
    hits as (select * from ranked r where rank <= {K}
        and exists (select 1 from {{all_hotels_named}} h where h.name = r.hotel_name))"""


@query("v15_search_hits", f"""
    with {SEARCH_HITS} select query_id, id, cast(rank as int) as rank, round(score, 6) as distance
    from hits""")
def _(t: Tables):
    return shown(search_all(t)["hits"]).select("query_id", "id", "rank", "distance")


@query("v15_search_status", f"""
    with {SEARCH_HITS},
    named as (select h.query_id, i.city from hits h join {{items}} i on i.id = h.id)
    select f.query_id, contains(f.question, '.') as safe,
        case when contains(f.question, '.') then '' else '{filters.UNSAFE_MESSAGE}' end as message,
        false as parse_failed, count(n.city) as result_count,
        case when count(n.city) > 0 then 4.0 else 0.0 end::double as mean_rating,
        count(distinct n.city) as city_count
    from inputs f left join named n on n.query_id = f.query_id group by 1, 2, 3""")
def _(t: Tables):
    return search_all(t)["status"]


@query("x1_completion_step", """
    select conv_id * 1000 + turn as query_id, '[' || text || ']' as content from {conversations}""")
def _(t: Tables):
    registry = default_registries()["completions"]
    registry.register("echo", complete_with(lambda xs: [f"[{x}]" for x in xs], "text", "content"))
    turns = t.conversations.selectExpr("conv_id * 1000 + turn as query_id", "text")
    return registry.get("echo")(turns)
