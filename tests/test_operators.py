import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from staylens.operators import addresses, aggregates, filters, joins, pages, payloads, sets, telemetry, windows
from staylens.plans import models


@pytest.fixture
def hotels(spark):
    return spark.createDataFrame(
        [("1", "A", "s", "Paris", "France", "x", "bigHotels"),
         ("1", "A2", None, None, None, "x", "hotels"),
         ("2", "B", "s", "PARIS ", "France", "x", "bigHotels")],
        "source_hotel_id string, hotel_name string, street_address string, city string, "
        "country string, source string, table_source string",
    )


@pytest.fixture
def reviews(spark):
    return spark.createDataFrame(
        [(1, "1", "Rome, Italy", "t1"), (2, "1", None, "t2"), (3, "9", "Rome, Italy", "t3"),
         (4, "9", "Rome", "t4"), (5, None, None, "t5")],
        "id int, hotel_id string, reviewer_location string, review_text string",
    )


def test_review_stats_keeps_fan_out(spark, rows, reviews, hotels):
    got = rows(aggregates.review_stats(reviews, hotels))
    # Hotel 1 stands in two tables; without a city the reviewer's counts.
    assert got == sorted(
        [("Paris", 2, 1), ("Rome", 3, 2), (None, 2, 1)], key=repr
    )


def test_coverage_of_unlisted_and_repeated_cities(spark, rows, reviews, hotels):
    cities = spark.createDataFrame(
        [(" paris", "France", None), ("PARIS", "France", "Europe"), ("Oslo", "Norway", None)],
        "city string, country string, continent string",
    )
    got = {r.city: r for r in models.city_coverage(cities, reviews, hotels).collect()}
    assert got["Oslo"].zero_hotels and got["Oslo"].zero_reviews
    # Two spellings of Paris among the hotels give two rows per listed city.
    assert models.city_coverage(cities, reviews, hotels).filter("city = 'PARIS'").count() == 2


def test_distinct_cities_option(spark, rows):
    arm = spark.createDataFrame([("Paris", "France")], "name string, country string")
    other = spark.createDataFrame([(" PARIS ", "France")], "name string, country string")
    assert models.dim_cities(arm, other, arm).count() == 3
    got = rows(models.dim_cities(other, arm, arm, distinct_cities=True), "city", "city_source")
    assert got == [(" PARIS ", "bigCity")]


def test_dedupe_by_hash_order(spark, rows):
    df = spark.createDataFrame(
        [(1, "h1", "Good", "a"), (2, "h1", "good ", "a"), (1, "h2", "GOOD", "b"), (7, "h", "other", "a")],
        "id int, hotel_id string, review_text string, table_source string",
    )
    assert rows(windows.dedupe_by_hash(df), "id", "table_source") == [(1, "b"), (7, "a")]


def test_missing_reviews_skips_embedded(spark, rows, hotels):
    arm = spark.createDataFrame(
        [(1, "1", "Seen before"), (2, "1", "Fresh")], "id long, hotel_id string, review_text string"
    )
    embedded = spark.createDataFrame(
        [(1, "seen  BEFORE"), (2, None)], "id long, review_text string"
    )
    reviews = models.all_reviews(arm, arm.limit(0), arm.limit(0), arm.limit(0))
    cities = models.dim_cities(
        *[spark.createDataFrame([("paris", "France")], "name string, country string")] * 3
    )
    got = models.missing_reviews(reviews, hotels, cities, embedded, embedded)
    # One review, two hotels of its id; the one with a city meets three city rows.
    assert [r.review_text for r in got.collect()] == ["Fresh"] * 4


def test_keep_first_and_last(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, p int, v string")
    assert rows(windows.keep_first(df, ["k"], ["p"]), "k", "v") == [("a", "x"), ("b", "z")]
    assert rows(windows.keep_last(df, ["k"], ["p"]), "k", "v") == [("a", "y"), ("b", "z")]


def test_top_cities_takes_all_below_n(spark):
    cities = spark.createDataFrame(
        [(f"I{i}", f"c{i:02}", "X", 1 + i % 2, "x") for i in range(30)] + [("J", "j", "Y", 1, "y")],
        "iata_code string, name string, country string, airport_count int, country_codes string",
    )
    got = windows.top_cities(cities).collect()
    assert len([r for r in got if r.country == "X"]) == 25
    assert len([r for r in got if r.country == "Y"]) == 1
    kept = sorted(r.name for r in got if r.country == "X" and r.airport_count == 1)
    assert kept == [f"c{i:02}" for i in range(0, 20, 2)]


def test_sorted_output(spark):
    cities = spark.createDataFrame(
        [("b", 2), ("a", 2), ("z", 9)], "name string, airport_count int"
    ).withColumn("iata_code", F.lit("X"))
    assert [r.name for r in windows.top_n(cities, 2).collect()] == ["z", "a"]
    df = spark.range(20)
    assert [r.id for r in windows.slice_rows(df, ["id"], 5, 3).collect()] == [5, 6, 7]
    assert windows.slice_rows(df, ["id"], 18).count() == 2


def test_slices_by_ranges(spark):
    keys = [(a, b) for a in (None, 1, 2, 3) for b in (None, "x", "y")] + [(i, "z") for i in range(4, 40)]
    df = spark.createDataFrame(keys, "a int, b string").repartition(5)
    order = sorted(keys, key=lambda k: [(v is not None, v) for v in k])
    for offset, limit in [(0, 3), (1, 2), (2, None), (5, 10), (11, 1), (30, 100), (47, None), (48, 2), (48, None), (0, 0)]:
        got = [tuple(r) for r in windows.slice_rows(df, ["a", "b"], offset, limit, parts=6).collect()]
        assert got == order[offset:][:limit], (offset, limit)
    assert windows.slice_rows(df.limit(0), ["a", "b"], 2).count() == 0


def test_deep_page_is_a_filter(spark):
    df = spark.range(30_000).withColumn("v", F.col("id") * 2)
    page = windows.slice_rows(df, ["id"], 20_000, 5)
    assert [r.id for r in page.collect()] == list(range(20_000, 20_005))


def test_quantiles_by_ranges(spark, rows):
    import math
    groups = {
        "a": [5.0, 1.0, 1.0, 1.0, None, 9.0], "b": [None], None: [2.0, float("inf"), float("nan"), -0.5],
        "c": [float(i * 7919 % 500) for i in range(1000)], "d": [3.0] * 50,
    }
    shares = [0.0, 0.25, 0.5, 0.999, 1.0]
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, value double")
    want = {}
    for k, vs in groups.items():
        vs = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), v))
        want[k] = (len(vs), [str(vs[max(math.ceil(len(vs) * s), 1) - 1]) if vs else "None" for s in shares])
    for parts in (None, 7):
        found = telemetry.quantile_rollup(df, ["k"], shares, parts).collect()
        assert {r.k: (r.events, [str(v) for v in r.quantiles]) for r in found} == want
    assert telemetry.quantile_rollup(df.limit(0), ["k"], shares).count() == 0


def test_reviews_for_hotel_order(spark):
    df = spark.createDataFrame(
        [("h", 1, 1, 1), ("h", 2, 3, 1), ("h", 3, 3, 2), ("g", 4, 9, 9)],
        "hotel_id string, id int, review_date int, created_at int",
    )
    assert [r.id for r in windows.reviews_for_hotel(df, "h").collect()] == [3, 2, 1]


def test_hotels_after(spark, rows):
    df = spark.createDataFrame(
        [("ta_633459", "t"), ("ta_633460", "t"), ("ta_7", "t"), ("x", "g")], "hotel_id string, source string"
    )
    assert [r.hotel_id for r in filters.hotels_after(df, "t").collect()] == ["ta_7"]
    assert filters.hotels_after(df).count() == 4


def test_union_pads_missing_columns(spark):
    arm = spark.createDataFrame([(1, "t")], "id long, review_text string")
    got = sets.union_reviews({"a": arm, "b": arm}).collect()
    assert [r.table_source for r in got] == ["a", "b"]
    assert got[0].rating is None and got[0].hotel_id is None


def test_normalise_queries(spark):
    forms = spark.createDataFrame(
        [(1, "", " Europe ", "Paris", "0", ""), (2, " q ", None, "Paris, France, x", " 4 ", " AUTO "),
         (3, None, "", "", "x", "grok"), (4, " ", "", ",", "-2", None)],
        "query_id int, question string, continent string, citycountry string, rating string, llm string",
    )
    got = {r.query_id: r for r in filters.normalise_queries(forms, "dflt", "gemini").collect()}
    assert (got[1].question, got[1].continent, got[1].filter_city_country) == ("dflt", "Europe", False)
    assert (got[1].filter_rating, got[1].rating, got[1].preferred_model) == (False, 0, "gemini")
    assert (got[2].question, got[2].city, got[2].country, got[2].rating) == ("q", "Paris", "France", 4)
    assert got[2].filter_rating and got[2].preferred_model == "gemini"
    assert (got[3].question, got[3].preferred_model, got[3].filter_rating) == ("dflt", "grok", False)
    # Blanks alone are not the empty question, and two empty parts are still two.
    assert (got[4].question, got[4].filter_city_country, got[4].preferred_model) == ("", True, "gemini")


def test_match_country(spark, rows):
    countries = spark.createDataFrame(
        [("Guinea", "GN", "GN"), ("Equatorial Guinea", "GQ", "GQ"), ("Niger", "NE", "NE")],
        "name string, iso2 string, codes string",
    )
    airports = spark.createDataFrame(
        [("GUINEA",), ("Equatorial Guinea",), ("Republic of Guinea",), ("Mars",), ("",), ("Nigeria",)],
        "country string",
    )
    got = dict(rows(joins.match_country(airports, countries), "country", "iso2"))
    assert got == {"GUINEA": "GN", "Equatorial Guinea": "GQ", "Republic of Guinea": "GN", "Mars": None,
                   "": None, "Nigeria": "NE"}


def test_by_ids_skips_non_numbers(spark, rows):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ids = spark.createDataFrame([("1",), ("x3",), ("2.0",), (None,), ("+3",)], "id string")
    assert rows(joins.by_ids(df, ids)) == [(1,), (3,)]


def test_refresh_audit(spark):
    df = spark.createDataFrame(
        [("h1", "p"), ("h1", "q"), ("h1", ""), ("h2", None), ("h3", "p")], "hotel_id string, photo_name string"
    )
    got = aggregates.refresh_audit(df).head()
    assert (got.read, got.matched, got.skipped_empty, got.skipped_duplicate) == (5, 2, 2, 1)
    assert aggregates.refresh_audit(df.limit(0)).head().read == 0


@pytest.mark.parametrize(
    "address, want",
    [
        ("1 Main St, Denver, CO 80202, USA", ("Denver", "USA", "CO", "80202")),
        ("1 Main St, Denver, CO, USA", ("", "USA", "", "")),
        ("5 Kent St, North Sydney NSW 2060, Australia", ("North Sydney", "Australia", "NSW", "")),
        ("Rua 1, Centro, Niteroi - RJ, 24000-000, Brazil", ("Niteroi", "Brazil", "RJ", "")),
        ("Rua 1, Niteroi - RJ, Brazil", ("", "Brazil", "", "")),
        ("Katu 1, 00530 Helsinki, Finland", ("00530", "Finland", "", "")),
        ("Katu 1, Helsinki, Finland", ("", "Finland", "", "")),
        ("Nowhere", ("", "Nowhere", "", "")),
        ("", ("", "", "", "")),
    ],
)
def test_address_parts(spark, address, want):
    df = spark.createDataFrame([(address,)], "a string")
    assert tuple(df.select(addresses.address_parts(F.col("a")).alias("p")).head().p) == want


def test_clean_city_requires_digit_by_option(spark):
    df = spark.createDataFrame([("00530 Helsinki",), ("Helsinki 00530",), ("St. Gallen!",), ("  ",)], "c string")
    plain = [r[0] for r in df.select(addresses.clean_city(F.col("c"))).collect()]
    assert plain == ["00530", "Helsinki", "St. Gallen!", "  "]
    strict = [r[0] for r in df.select(addresses.clean_city(F.col("c"), True)).collect()]
    assert strict == ["Helsinki", "Helsinki", "St. Gallen!", "  "]


def test_paths(spark, rows):
    df = spark.createDataFrame(
        [("Oslo,Norway/12_google_The_Inn.html",), ("Oslo,Norway/ta_9_yelp_The_Inn.html",),
         ("Oslo/12_google_x.html",), ("Oslo,Norway/12_google.html",), ("a,b/c/12_google_x.html",),
         ("Oslo,Norway/12_google_x.txt",)],
        "path string",
    )
    assert rows(pages.parse_path_a(df), "hotel_id", "source", "name") == [
        ("12", "google", "The Inn"), ("ta", "9", "yelp The Inn"),
    ]
    assert rows(pages.parse_path_a(df, ("ta",)), "hotel_id", "source") == [("12", "google"), ("ta_9", "yelp")]
    more = spark.createDataFrame(
        [("Oslo,Norway/reviews-the_inn-ta_9.html",), ("Oslo,Norway/reviews-x-google_a-b.html",),
         ("Oslo,Norway/search-x-1.html",), ("Oslo/reviews-x-1.html",)],
        "path string",
    )
    assert rows(pages.parse_path_b(more), "hotel_id") == [("b",), ("ta_9",)]
    assert rows(pages.parse_path_b(more, ("ta", "google")), "hotel_id") == [("google_a-b",), ("ta_9",)]


def test_cards_in_broken_markup(spark, rows):
    html = """<p>ad<p>more<div data-test-target="HR_CC_CARD"><div class="_a z"><a><span><span> T &amp; t
      </span></span></a></div><div class="_c"><div class="bgMZj fIrGe _T"><div><span><div><span>Body
      </span></div></span></div></div></div></section></div>
      <div data-test-target="HR_CC_CARD"></div><div data-test-target="OTHER">x</div>"""
    df = spark.createDataFrame([("p", html), ("q", "<<<"), ("r", None)], "path string, html string")
    assert rows(pages.extract_cards(df)) == [("p", 0, "T & t", "", "Body")]


def test_list_reviews_fall_back_to_paragraph(spark, rows):
    html = """<div id="reviews"><section><div class="y-css-mhg9c5"><ul>
      <li><p>first<li><div role="img" aria-label="3 star rating"></div><p>second</p>
      <li><span>no text</span></ul></div></section></div>"""
    df = spark.createDataFrame([("p", html)], "path string, html string")
    assert rows(pages.extract_list_reviews(df)) == [("p", 0, "", "first", 0.0), ("p", 1, "", "second", 3.0)]


def test_completions(spark, rows):
    item = '{"Hotel":"H","Rating":4,"Extra":1}'
    df = spark.createDataFrame(
        [(1, f"```json\n[{item}]\n```"), (2, f"[{item}, {item}]"), (3, f"``` [{item}] ```"), (4, "null"),
         (5, " "), (6, "[broken"), (7, item), (8, f"[{item}]```"), (9, None), (10, "[]"),
         (11, f"[{item}] trailing"), (12, "[{'Hotel':'A'}]"), (13, '[{"Hotel":"A","Rating":"4.5"}]'), (14, '[1]'),
         (15, f'[{item}],"w":1')],
        "query_id int, content string",
    )
    items, failed = payloads.parse_completions(df)
    counts = {r.query_id: r["count"] for r in items.groupBy("query_id").count().collect()}
    assert counts == {1: 1, 2: 2, 3: 1, 8: 1, 13: 1}
    assert sorted(q for q, bad in rows(failed) if bad) == [6, 7, 11, 12, 14, 15]
    assert items.filter("query_id = 1").head().Rating == 4.0
    assert items.filter("query_id = 13").head().Rating == 4.5
    # Fields without a column are kept in the item.
    assert json.loads(items.filter("query_id = 1").head()["item"]) == json.loads(item)


def test_ragged_vectors_are_refused():
    import pyarrow as pa

    from staylens.operators import vectors

    with pytest.raises(ValueError):
        vectors._matrix(pa.array([[0.0] * 63, [0.0] * 65]))


def test_payload_edges(spark):
    empty = spark.createDataFrame([("h", '{"data":[]}'), ("h", "{"), ("h", "{}")], "hotel_id string, payload string")
    assert payloads.parse_hotel_search(empty).count() == 0
    assert payloads.parse_hotel_ratings(empty).count() == 0
    assert payloads.parse_photo(empty).filter("photo_name = ''").count() == 3
    as_of = F.lit("2024-01-01").cast("timestamp")
    dated = '{"data":[{"text":"t","title":"T","published_date":"%s"}]}'
    df = spark.createDataFrame(
        [("h", dated % "2 months ago"), ("h", dated % "whenever")], "hotel_id string, payload string"
    )
    got = payloads.parse_reviews_a(df, as_of).collect()
    assert [(r.review_text, str(r.review_date), r.rating) for r in got] == [("T\nt", "2023-11-01 00:00:00", 0.0)]


def test_unknown_rating_source_fails(spark):
    from staylens.operators import merges

    hotels = spark.createDataFrame([("h", 1.0)], "hotel_id string, google_rating double").withColumns(
        {c: F.lit(None).cast("double") for c in ("amadeus_rating", "tripadvisor_rating", "booking_rating")}
    )
    updates = spark.createDataFrame([("h", "bing", 2.0, 1)], "hotel_id string, source string, rating double, pos int")
    with pytest.raises(PySparkException, match="unknown source: bing"):
        merges.apply_ratings(hotels, updates, "pos").collect()


def test_build_models(spark, rows, tmp_path):
    from staylens.catalog.tables import Tables
    from staylens.plans.build import build_models

    t = Tables(spark, "/root/testdata/sf0.001")
    built = build_models(
        str(tmp_path), [t.hotels_a, t.hotels_b, t.hotels_c],
        [t.reviews_a, t.reviews_b, t.reviews_c, t.reviews_d],
        [t.big_city, t.cities, t.airport_city], [t.embedded_a, t.embedded_b],
    )
    direct = models.city_coverage(t.dim_cities, t.all_reviews, t.all_hotels)
    assert rows(built["city_coverage"]) == rows(direct)
    assert all(df.count() for df in built.values())
