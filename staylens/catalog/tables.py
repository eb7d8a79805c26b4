"""Domain tables for the registered queries, derived from the given tables.

Each text is plain SQL that Spark and DuckDB both run, so a query and its
reference SQL start from the same rows. Every table covers the whole of the
tables it is made from.
"""

from __future__ import annotations

import re
from collections import ChainMap

from pyspark.sql import DataFrame, SparkSession, functions as F

from staylens.plans import models
from staylens.sources.tables import scan, spread

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Tables whose rows cost much more to process than to move.
TEXT_TABLES = ["documents", "pages", "conversations"]

DERIVED = {
    # Cities of three tables; the second and third spell some names differently.
    "big_city": """
        select n.n_name as name, r.r_name as country, r.r_name as continent
        from {nation} n join {region} r on r.r_regionkey = n.n_regionkey""",
    "cities": """
        select case when n.n_nationkey % 2 = 0 then n.n_name else ' ' || lower(n.n_name) || ' ' end
            as name, r.r_name as country
        from {nation} n join {region} r on r.r_regionkey = n.n_regionkey""",
    "airport_city": """
        select 'A' || chr(65 + cast(n.n_nationkey as int)) || 'X' as iata_code,
            lower(n.n_name) as name, r.r_name as country,
            cast(1 + n.n_nationkey % 4 as int) as airport_count, 'C' || n.n_nationkey as country_codes
        from {nation} n join {region} r on r.r_regionkey = n.n_regionkey""",
    # Hotels: suppliers, customers, and suppliers again as an older landing.
    "hotels_a": """
        select cast(s.s_suppkey as string) as source_hotel_id, s.s_name as name,
            s.s_suppkey || ' Main Street' as street_address, n.n_name as city, r.r_name as country,
            'google' as source, 'google_' || s.s_suppkey as hotel_id, s.s_suppkey as id
        from {supplier} s join {nation} n on n.n_nationkey = s.s_nationkey
        join {region} r on r.r_regionkey = n.n_regionkey""",
    "hotels_b": """
        select 'ta_' || c.c_custkey as source_hotel_id, c.c_name as name,
            c.c_custkey || ' High Street' as street_address, n.n_name as city, r.r_name as country,
            'tripadvisorAPI' as source, 'ta_' || c.c_custkey as hotel_id, c.c_custkey as id
        from {customer} c join {nation} n on n.n_nationkey = c.c_nationkey
        join {region} r on r.r_regionkey = n.n_regionkey""",
    "hotels_c": """
        select case when s.s_acctbal >= 5000 then cast(s.s_suppkey as string)
                else 'old_' || s.s_suppkey end as source_hotel_id,
            upper(s.s_name) as name, cast(null as string) as street_address,
            case when s.s_acctbal >= 2000 then lower(n.n_name) end as city,
            case when s.s_acctbal >= 2000 then r.r_name end as country, 'amadeus' as source,
            'old_' || s.s_suppkey as hotel_id, s.s_suppkey as id
        from {supplier} s join {nation} n on n.n_nationkey = s.s_nationkey
        join {region} r on r.r_regionkey = n.n_regionkey""",
    # Reviews: about a third of the hotel ids have no hotel, some reviewers no location.
    "reviews": """
        select d.doc_id as id,
            cast(cast(floor(d.doc_id / 7) as bigint) as string) as hotel_id,
            case when d.doc_id % 3 = 0 then 'google' when d.doc_id % 3 = 1 then 'tripadvisorAPI'
                else 'yelp' end as source,
            'r' || d.doc_id as source_review_id, 'i' || d.doc_id as insert_id, d.text as review_text,
            d.source as reviewer_name, n.n_name || ', ' || r.r_name as reviewer_location,
            cast(1 + d.doc_id % 5 as double) as rating,
            cast(date '2024-01-01' + cast(d.doc_id % 365 as int) as timestamp) as review_date,
            cast(date '2025-01-01' + cast(d.doc_id % 100 as int) as timestamp) as created_at,
            'https://maps.example.com/' || d.doc_id as google_maps_uri,
            case when d.doc_id % 4 = 0 then '' else 'places/' || d.doc_id % 8 end as photo_name,
            cast(substr(d.source, 4) as int) as source_no
        from {documents} d left join {nation} n on n.n_nationkey = d.doc_id % 30
        left join {region} r on r.r_regionkey = n.n_regionkey""",
    # Four landed review tables by source; together they hold every review.
    "reviews_a": """
        select id, hotel_id, source_review_id, insert_id, review_text, reviewer_name,
            reviewer_location, rating, review_date, google_maps_uri, photo_name
        from {reviews} where source_no < 9""",
    "reviews_b": "select id, hotel_id, review_text, reviewer_name from {reviews}"
                 " where source_no between 9 and 12",
    "reviews_c": "select id, hotel_id, review_text, reviewer_name from {reviews}"
                 " where source_no between 13 and 15",
    "reviews_d": """
        select id, hotel_id, source_review_id, insert_id, review_text, reviewer_name,
            reviewer_location, rating, review_date, google_maps_uri, photo_name
        from {reviews} where source_no > 15""",
    # Embedded texts: labelled documents of good quality, and those that are not toxic.
    "embedded_a": """
        select d.doc_id as id, d.text as review_text from {documents} d
        join {labels} l on l.doc_id = d.doc_id where l.quality = 1""",
    "embedded_b": """
        select d.doc_id as id, d.text as review_text from {documents} d
        join {labels} l on l.doc_id = d.doc_id where l.toxic = 0""",
    # Indexed reviews: a document with its vector, placed by the vector's label.
    "items": """
        select e.vec_id as id, e.embedding, v.review_text, v.hotel_id,
            coalesce(s.s_name, 'Unlisted') as hotel_name, n.n_name as city, r.r_name as country,
            r.r_name as continent, cast(1 + e.label % 5 as double) as rating, v.reviewer_name,
            v.google_maps_uri, v.photo_name, v.review_date, e.label
        from {embeddings} e join {reviews} v on v.id = e.vec_id
        left join {supplier} s on cast(s.s_suppkey as string) = v.hotel_id
        join {nation} n on n.n_nationkey = e.label
        join {region} r on r.r_regionkey = n.n_regionkey""",
    # Search forms: every user turn of the conversations.
    "forms": """
        select c.conv_id * 1000 + c.turn as query_id,
            case when c.turn = 6 then '' else '  ' || c.text || ' ' end as question,
            case when c.conv_id % 3 = 0 then ' ' || r.r_name || ' ' else '' end as continent,
            case when c.conv_id % 4 = 0 then n.n_name || ' , ' || r.r_name
                when c.conv_id % 4 = 1 then n.n_name
                when c.conv_id % 4 = 2 then n.n_name || ',' || r.r_name || ',x' else '' end
                as citycountry,
            case when c.turn % 4 = 0 then ' 3 ' when c.conv_id % 5 = 0 then '0'
                when c.conv_id % 5 = 1 then 'x' else '' end as rating,
            case when c.conv_id % 4 = 0 then 'grok' when c.conv_id % 4 = 1 then ' Auto '
                when c.conv_id % 4 = 2 then 'OpenAI' else '' end as llm
        from {conversations} c join {nation} n on n.n_nationkey = c.conv_id % 25
        join {region} r on r.r_regionkey = n.n_regionkey where c.role = 'user'""",
    # Telemetry: every event with the attributes the counters group by.
    "telemetry": """
        select event_id, cast(ts as timestamp) as ts, event_type as metric,
            'model_' || user_id % 3 as model, case when event_id % 2 = 0 then 'prompt'
            else 'completion' end as type, value < 100 as success, event_id % 7 <> 0 as safe, value
        from {events}""",
    # Airports: parts as airports of nations, some countries under a longer name.
    "airports": """
        select p.p_partkey as pos, cast(p.p_partkey as string) as id, p.p_name as name,
            case when p.p_size % 10 = 0 then upper(split_part(p.p_name, ' ', 2))
                when p.p_size % 11 = 0 then '' else split_part(p.p_name, ' ', 2) || p.p_size % 20 end
                as city,
            case when p.p_partkey % 3 = 0 then 'Republic of ' || n.n_name
                when p.p_partkey % 7 = 0 then 'Atlantis' else n.n_name end as country,
            case when p.p_size = 7 then '\\N' when p.p_size = 8 then 'AB' else
                chr(65 + cast(p.p_partkey % 26 as int))
                || chr(65 + cast((p.p_partkey % 676 - p.p_partkey % 26) / 26 as int))
                || chr(65 + cast(p.p_size % 26 as int)) end as iata,
            case when p.p_size = 9 then 'station' else 'airport' end as type
        from {part} p join {nation} n on n.n_nationkey = p.p_partkey % 25""",
    "countries": """
        select n_name as name, 'C' || n_nationkey as iso2,
            'C' || n_nationkey || case when n_nationkey % 2 = 0 then '' else ',X' || n_nationkey end
                as codes
        from {nation}""",
}




# The same white space as a character class, for the reference SQL.
WHITE = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def trimmed(x: str) -> str:
    """SQL that trims all white space."""
    return f"regexp_replace({x}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def hashed(x: str) -> str:
    """SQL of the hash of a normalised text."""
    return f"md5({trimmed(_spaced(x))})"


def _spaced(x: str) -> str:
    return f"regexp_replace(lower({x}), '[\\t\\n\\f\\r ]+', ' ', 'g')"


# The models as SQL, for the reference side only; queries build them from operators.
MODELS = {
    "all_hotels": """
        select source_hotel_id, name as hotel_name, street_address, city, country, source,
            'bigHotels' as table_source from {hotels_a}
        union all select source_hotel_id, name, street_address, city, country, source, 'hotels'
            from {hotels_b}
        union all select source_hotel_id, name, street_address, city, country, source,
            'hotels_old_amadeusdev' from {hotels_c}""",
    "union_reviews": """
        select *, 'main_hotel_reviews_all_110k' as table_source from {reviews_a}
        union all by name select *, 'bigReview' as table_source from {reviews_b}
        union all by name select *, 'reviews' as table_source from {reviews_c}
        union all by name select *, 'intermediate_upload' as table_source from {reviews_d}""",
    "all_reviews": f"""
        select * from (select *, {hashed('review_text')} as review_text_hash
            from {{union_reviews}} where review_text is not null)
        qualify row_number() over (partition by review_text_hash
            order by table_source desc, id desc, hotel_id, md5(review_text)) = 1""",
    "dim_cities": """
        select name as city, country, continent, 'bigCity' as city_source from {big_city}
        union all select name, country, null, 'cities' from {cities}
        union all select name, country, null, 'airportCity' from {airport_city}""",
    "embedded": f"""
        select {hashed('review_text')} as review_text_hash from {{embedded_a}}
        union select {hashed('review_text')} from {{embedded_b}}""",
}
# Other modules add to DERIVED, so both are looked up when needed.
CTES = ChainMap(DERIVED, MODELS)


def names_in(text: str) -> list[str]:
    return [n for n in re.findall(r"\{(\w+)\}", text) if n in CTES or n in BASE]


def with_tables(sql: str) -> str:
    """Standalone SQL: the derived tables a text refers to become its CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in names_in(text):
            if name in CTES and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    known = {*BASE, *CTES}

    def fill(text: str) -> str:
        return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in known else m[0], text)

    ctes = ",\n".join(f"{name} as ({fill(CTES[name])})" for name in order)
    body = fill(sql)
    if not ctes:
        return body
    if body.lstrip().lower().startswith("with "):
        return f"with {ctes},\n{body.lstrip()[5:]}"
    return f"with {ctes}\n{body}"


class Tables:
    """Given and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in CTES):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self._read(name)
            else:
                self._made[name] = self._derive(name) if name in DERIVED else self._model(name)
        return self._made[name]

    def _model(self, name: str) -> DataFrame:
        reviews = [self.reviews_a, self.reviews_b, self.reviews_c, self.reviews_d]
        if name == "all_hotels":
            return models.all_hotels(self.hotels_a, self.hotels_b, self.hotels_c)
        if name == "all_reviews":
            return models.all_reviews(*reviews)
        if name == "dim_cities":
            return models.dim_cities(self.big_city, self.cities, self.airport_city)
        if name == "union_reviews":
            return models.union_reviews(dict(zip(models.REVIEW_LABELS, reviews)))
        return models.embedded_hashes(self.embedded_a, self.embedded_b)

    def _read(self, name: str) -> DataFrame:
        df = scan(self.spark, self.folder, name)
        if name in TEXT_TABLES:
            df = spread(df)
        local = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df

    def _derive(self, name: str) -> DataFrame:
        text = DERIVED[name]
        inputs = {n: getattr(self, n) for n in dict.fromkeys(names_in(text))}
        # SQL strings read backslashes as escapes.
        return self.spark.sql(text.replace("\\", "\\\\"), **inputs)
