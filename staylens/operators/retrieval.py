"""Prompt assembly, provider fallback and answers of search requests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from staylens.functions.text import fixed3, plain_number, plain_value, trim_ws
from staylens.operators.aggregates import result_stats
from staylens.operators.filters import apply_safety, normalise_queries, safety_flag
from staylens.operators.joins import attach_rank, hydrate
from staylens.operators.payloads import parse_completions
from staylens.operators.vectors import DEFAULT_NEIGHBOURS, embed, knn_filtered
from staylens.operators.windows import keep_first
from staylens.session import shared_dir, store

# Providers, fallbacks, retryable messages, prompt and media texts.
DEFAULT_PROVIDER = "gemini"
FALLBACKS = {
    "gemini": ["gemini", "grok", "openai"],
    "grok": ["grok", "gemini", "openai"],
    "openai": ["openai", "gemini", "grok"],
}
RETRYABLE = ["429", "rate limit", "timeout", "temporarily", "unavailable", "resource exhausted"]
ALL_FAILED = "all completion providers failed: "
ERROR_SEPARATOR = " | "
#: What a provider may answer beside ``query_id``; columns it leaves out are null.
ANSWER = {"content": "string", "error": "string", "prompt_tokens": "long", "completion_tokens": "long"}
#: Error of a query a provider was asked and gave neither content nor error for; retryable.
NO_ANSWER = "unavailable: no answer"
PROMPT_NOTE = (
    "Important: If a review has a google_maps_uri or photo_name, you MUST include them in the "
    "JSON output."
)
BLOCK_LABELS = [
    ("Hotel", "hotel_name"), ("City", "city"), ("Review", "review_text"), ("Rating", "rating"),
    ("Distance", "distance"), ("Address", "street_address"), ("GoogleMapsURI", "google_maps_uri"),
    ("PhotoName", "photo_name"),
]
MEDIA_URL = "https://places.googleapis.com/v1/"
THUMB_WIDTH, FULL_WIDTH = 120, 800


def hydrate_hits(hits: DataFrame, items: DataFrame, hotels: DataFrame) -> DataFrame:
    """Hits of the search with review and hotel columns, in rank order per query."""
    # The hit ids come first: they prune the reviews before hotels are joined by name.
    wanted = items.join(hits.select(F.col("id").cast("bigint")).distinct(), "id", "left_semi")
    return attach_rank(hits, hydrate(wanted.drop("embedding"), hotels))


def _block_value(column: str) -> Column:
    if column == "rating":
        return plain_number(F.col(column))
    if column == "distance":
        return fixed3(F.col(column))
    return plain_value(F.col(column))


def review_block(number: Column) -> Column:
    """The labelled lines of one review in a prompt."""
    lines = [F.concat(F.lit("Review "), number.cast("string"), F.lit(":"))]
    lines += [F.concat(F.lit(f"{label}: "), _block_value(c)) for label, c in BLOCK_LABELS]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def build_prompts(queries: DataFrame, hits: DataFrame, header: str) -> DataFrame:
    """One prompt per query from its ranked hits; a query has at most k of them."""
    blocks = hits.select(
        "query_id", F.struct("rank", review_block(F.col("rank")).alias("block")).alias("_b")
    )
    joined = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list("_b")).alias("_b"))
    text = F.array_join(F.transform("_b", lambda b: b["block"]), "")
    prompt = F.concat(
        F.lit(f"{header}\n\nUser Question: "), "question",
        F.lit(f"\n\n{PROMPT_NOTE}\n\nReviews:\n"), text,
    )
    return queries.join(joined, "query_id").select("query_id", "question", prompt.alias("prompt"))


def resolve_chain(df: DataFrame, available: list[str], preferred: str = DEFAULT_PROVIDER,
                  col: str = "preferred_model") -> DataFrame:
    """Providers to try for each query: the chosen one, then the fixed fallbacks."""
    asked = F.lower(trim_ws(F.coalesce(col, F.lit(""))))
    fallback = preferred.strip().lower() or DEFAULT_PROVIDER
    chosen = F.when(asked.isin("", "auto"), F.lit(fallback)).otherwise(asked)

    def usable(names: list[str]) -> Column:
        kept = [F.lit(n) for n in names if n in available]
        return F.array(*kept) if kept else F.array().cast("array<string>")

    chain = F.when(chosen == "grok", usable(FALLBACKS["grok"]))
    chain = chain.when(chosen == "openai", usable(FALLBACKS["openai"]))
    return df.withColumn("chain", chain.otherwise(usable(FALLBACKS["gemini"])))


def is_retryable(c: Column) -> Column:
    """An error worth trying the next provider for."""
    return F.coalesce(F.lower(c).rlike("|".join(RETRYABLE)), F.lit(False))


def resolve_attempts(attempts: DataFrame) -> DataFrame:
    """Outcome per query of its logged attempts.

    The first attempt, in chain order, that succeeded or failed for good ends
    the chain. Success yields its content, failure the joined error texts. A
    chain position counts once, so a query brings at most one row per provider.
    """
    once = keep_first(attempts, ["query_id", "chain_pos"], ["attempt_no"])
    ends = F.col("ok") | ~is_retryable(F.col("error"))
    step = F.struct("chain_pos", ends.alias("ends"), "ok", "provider", "content", "error")
    steps = once.groupBy("query_id").agg(F.array_sort(F.collect_list(step)).alias("s"))
    last = F.coalesce(
        F.array_min(F.transform(F.filter("s", lambda x: x["ends"]), lambda x: x["chain_pos"])),
        F.array_max(F.transform("s", lambda x: x["chain_pos"])),
    )
    steps = steps.withColumn("_last", last)
    final = F.get(F.filter("s", lambda x: x["chain_pos"] == F.col("_last")), F.lit(0))
    tried = F.filter("s", lambda x: x["chain_pos"] <= F.col("_last"))
    errors = F.transform(
        tried, lambda x: F.concat(x["provider"], F.lit(": "), F.coalesce(x["error"], F.lit("")))
    )
    won = F.col("final.ok")
    return steps.withColumn("final", final).select(
        "query_id",
        won.alias("ok"),
        F.when(won, F.col("final.provider")).alias("provider"),
        F.when(won, F.col("final.content")).alias("content"),
        F.when(
            ~won, F.concat(F.lit(ALL_FAILED), F.array_join(errors, ERROR_SEPARATOR))
        ).alias("error"),
    )


def _attempt(asked: DataFrame, complete: Callable[[DataFrame], DataFrame], provider: str,
             position: int) -> DataFrame:
    """One attempt per asked query, also where the provider gave no row."""
    given = complete(asked)
    for c, kind in ANSWER.items():
        given = given.withColumn(c, F.col(c).cast(kind) if c in given.columns else F.lit(None).cast(kind))
    met = asked.select("query_id").join(given.select("query_id", *ANSWER), "query_id", "left")
    error = F.when(F.col("content").isNull(), F.coalesce("error", F.lit(NO_ANSWER))).otherwise(F.col("error"))
    return met.withColumn("error", error).select(
        "query_id", F.lit(position).alias("chain_pos"), F.lit(1).alias("attempt_no"),
        F.lit(provider).alias("provider"), F.col("error").isNull().alias("ok"), *ANSWER)


def complete_chain(
    prompts: DataFrame,
    providers: dict[str, Callable[[DataFrame], DataFrame]],
    folder: str,
    preferred: str = DEFAULT_PROVIDER,
    col: str = "preferred_model",
) -> tuple[DataFrame, DataFrame]:
    """Outcome per query and all attempts, of completions that fall back along a provider chain.

    ``prompts`` holds one row per query: query_id, question, prompt and the model asked
    for. A provider maps (query_id, question, prompt) to one row per query with
    content or error and, if it knows them, the tokens used. It gets only the queries
    that are still open: not answered, and without an error that a retry cannot mend.
    Every step of the chain is written below ``folder`` before the next begins, so no
    provider is called twice for a query; there are as many steps as providers.
    An outcome has query_id, ok, provider, content, error and the tokens of the winning attempt.
    """
    unknown = sorted(set(providers) - set(FALLBACKS))
    if unknown or not providers:
        raise ValueError(f"providers must be some of {sorted(FALLBACKS)}, not {unknown}")
    chained = resolve_chain(prompts, list(providers), preferred, col)
    still_open = store(chained.select("query_id", "question", "prompt", "chain"), f"{folder}/chains")
    steps = []
    for position in range(len(providers)):
        turn = still_open.withColumn("_provider", F.get("chain", F.lit(position)))
        tried = [
            _attempt(turn.filter(F.col("_provider") == name).select("query_id", "question", "prompt"),
                     complete, name, position)
            for name, complete in providers.items()
        ]
        steps.append(store(reduce(DataFrame.unionByName, tried), f"{folder}/attempts-{position}"))
        again = steps[-1].filter(~F.col("ok") & is_retryable(F.col("error")))
        still_open = still_open.join(again.select("query_id"), "query_id", "left_semi")
    attempts = reduce(DataFrame.unionByName, steps)
    used = attempts.filter("ok").select("query_id", "prompt_tokens", "completion_tokens")
    return resolve_attempts(attempts).join(used, "query_id", "left"), attempts


def enrich_media(df: DataFrame, key: str) -> DataFrame:
    """Map and photo links of rows that have a map address or a photo name."""

    def media(width: int) -> Column:
        url = F.concat(
            F.lit(MEDIA_URL), "photo_name", F.lit(f"/media?maxWidthPx={width}&key={key}")
        )
        return F.when(F.col("photo_name") != "", url)

    return df.withColumns(
        {
            "map_url": F.when(F.col("google_maps_uri") != "", F.col("google_maps_uri")),
            "photo_thumb": media(THUMB_WIDTH),
            "photo_full": media(FULL_WIDTH),
        }
    )


def search(
    forms: DataFrame,
    items: DataFrame,
    hotels: DataFrame,
    embedder: Callable[[list[str]], np.ndarray],
    judge: Callable[[DataFrame], DataFrame],
    complete: Callable[[DataFrame], DataFrame] | dict[str, Callable[[DataFrame], DataFrame]],
    question: str,
    header: str,
    key: str = "",
    k: int = DEFAULT_NEIGHBOURS,
    model: str = DEFAULT_PROVIDER,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """A batch of search requests from form fields to enriched answer rows.

    ``judge`` maps (query_id, question) to (query_id, answer) and ``complete``
    maps (query_id, question, prompt) to (query_id, content). Unsafe questions
    leave before embedding, search and completion. Verdicts, hits and answers are
    written below ``folder``, so every model is called once per question.

    With a dict of providers in place of ``complete``, each question goes along the chain
    of its preferred model (see ``complete_chain``). The status then also tells the model
    that answered, its tokens, the number of hits and the error of a query that no
    provider answered, and the result holds ``attempts`` and, for the telemetry
    rollups, ``usage``.
    """
    folder = folder or shared_dir(forms.sparkSession, "search")
    inputs = normalise_queries(forms, question, model)
    verdicts = safety_flag(judge(inputs.select("query_id", "question")))
    judged = inputs.join(verdicts.select("query_id", "safe"), "query_id", "left").withColumn(
        "safe", F.coalesce("safe", F.lit(False))
    )
    judged = store(judged, f"{folder}/inputs")
    safe = judged.filter("safe")
    vectors = embed(safe.drop("safe"), embedder, "question")
    hits = store(knn_filtered(items, vectors, k), f"{folder}/hits")
    found = hydrate_hits(hits, items, hotels)
    prompts = build_prompts(safe, found, header)
    if isinstance(complete, dict):
        asked = prompts.join(safe.select("query_id", "preferred_model"), "query_id")
        outcomes, attempts = complete_chain(asked, complete, folder, model)
        completed = store(outcomes, f"{folder}/answers")
    else:
        completed = store(complete(prompts), f"{folder}/answers").withColumn("error", F.lit(None).cast("string"))
    answers = judged.join(completed, "query_id", "left")
    # Queries without hits are answered by an empty list, those whose providers failed not at all.
    answers = answers.withColumn(
        "content", F.when(F.col("error").isNull(), F.coalesce("content", F.lit("[]"))))
    gated = apply_safety(answers.select("query_id", "safe", "content", "error"))
    answered = gated.filter(F.col("safe") & F.col("error").isNull())
    rows, failed = parse_completions(answered.select("query_id", "content"))
    shown = enrich_media(rows, key) if key else rows
    stats = result_stats(
        shown.select("query_id", F.col("Rating").alias("rating"), F.col("City").alias("city")),
        "query_id",
    )
    status = (
        gated.select("query_id", "safe", "message")
        .join(failed, "query_id", "left")
        .join(stats, "query_id", "left")
        .na.fill({"parse_failed": False, "result_count": 0, "mean_rating": 0.0, "city_count": 0})
    )
    out = {"hits": found, "prompts": prompts, "rows": shown, "status": status}
    if isinstance(complete, dict):
        counted = hits.groupBy("query_id").agg(F.count("*").alias("vector_count"))
        told = completed.select(
            "query_id", F.col("provider").alias("model"), "prompt_tokens", "completion_tokens", "error")
        out["status"] = status.join(told, "query_id", "left").join(counted, "query_id", "left").na.fill(
            {"vector_count": 0})
        out["attempts"] = attempts
        out["usage"] = told.filter("model is not null").drop("error")
    return out
