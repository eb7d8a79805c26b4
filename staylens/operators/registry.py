"""Extension points: providers, review sources, embedders and model calls by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from staylens.functions.vectors import hashing_embedder
from staylens.operators import pages, payloads


@dataclass
class Registry:
    """Jobs by name; a name can be registered once."""

    kind: str
    entries: dict[str, Callable] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)

    def register(self, name: str, job: Callable, enabled: bool = True) -> None:
        if name in self.entries:
            raise ValueError(f"{self.kind} registered twice: {name}")
        self.entries[name] = job
        if not enabled:
            self.disabled.add(name)

    def enabled(self) -> list[str]:
        return [name for name in self.entries if name not in self.disabled]

    def get(self, name: str) -> Callable:
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind}: {name}")
        if name in self.disabled:
            raise ValueError(f"{self.kind} is disabled: {name}")
        return self.entries[name]


def complete_with(fn: Callable[[list[str]], list[str]], column: str,
                  out: str) -> Callable[[DataFrame], DataFrame]:
    """Turn a batched text-to-text call into a DataFrame step keyed by query."""

    def step(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)["query_id"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"query_id": batch["query_id"], out: fn(batch[column].tolist())})

        return df.select("query_id", column).mapInPandas(run, f"query_id {kind}, {out} string")

    return step


def default_registries() -> dict[str, Registry]:
    """Registries filled with the built-in jobs."""
    hotels = Registry("hotel provider")
    hotels.register(payloads.AMADEUS, payloads.parse_hotel_list)
    hotels.register(payloads.GOOGLE, payloads.parse_places)
    hotels.register(payloads.TRIPADVISOR, payloads.parse_location_search)
    hotels.register(payloads.YELP, payloads.parse_business_search, enabled=False)
    reviews = Registry("review source")
    reviews.register(payloads.TRIPADVISOR, payloads.parse_reviews_a)
    reviews.register(payloads.GOOGLE, payloads.parse_reviews_b)
    reviews.register("saved_cards", pages.extract_cards)
    reviews.register("saved_lists", pages.extract_list_reviews)
    embedders = Registry("embedder")
    embedders.register("hashing", hashing_embedder())
    return {
        "hotels": hotels, "reviews": reviews, "embedders": embedders,
        "completions": Registry("completion provider"),
    }
