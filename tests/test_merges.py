import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from staylens.operators import merges

HOTEL = "hotel_id string, name string, city string, google_rating double, quiet boolean, photo_name string"
UPDATE = "pos int, " + HOTEL
hotel = st.tuples(
    st.sampled_from("abcd"), st.sampled_from(["", "N", "M"]), st.sampled_from(["", "P", None]),
    st.sampled_from([0.0, 4.5, None]), st.booleans(), st.sampled_from(["", "p"]),
)
few = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frames(spark, stored, changes):
    target = {h[0]: h for h in stored}
    updates = [(i, *h) for i, h in enumerate(changes)]
    return spark.createDataFrame(list(target.values()), HOTEL), spark.createDataFrame(updates, UPDATE)


def upsert_one_by_one(stored, changes):
    """The merge as a loop over the updates."""
    table = {h[0]: list(h) for h in stored}
    for change in changes:
        row = table.get(change[0])
        if row is None:
            table[change[0]] = list(change)
        else:
            for i, value in enumerate(change):
                if value:
                    row[i] = value
    return sorted((tuple(r) for r in table.values()), key=repr)


def blank(row):
    # An absent number or text and its zero value mean the same.
    return tuple(None if v in ("", 0.0, False) else v for v in row)


@few
@given(st.lists(hotel, max_size=4), st.lists(hotel, max_size=6))
def test_upsert_hotels(spark, rows, stored, changes):
    target, updates = frames(spark, stored, changes)
    merged = merges.upsert_hotels(target, updates, "pos").cache()
    want = upsert_one_by_one({h[0]: h for h in stored}.values(), changes)
    assert sorted(map(blank, rows(merged)), key=repr) == sorted(map(blank, want), key=repr)
    assert rows(merges.upsert_hotels(merged, updates, "pos")) == rows(merged)


@few
@given(st.lists(hotel, max_size=4), st.lists(hotel, max_size=6))
def test_upsert_list_is_idempotent(spark, rows, stored, changes):
    target, updates = frames(spark, stored, changes)
    merged = merges.upsert_hotels_list(target, updates, "pos").cache()
    assert rows(merges.upsert_hotels_list(merged, updates, "pos")) == rows(merged)
    table = {h[0]: list(h) for h in stored}
    for change in changes:
        row = table.setdefault(change[0], list(change))
        row[1:3] = change[1:3]
    assert rows(merged) == sorted((tuple(r) for r in table.values()), key=repr)


def test_inserted_hotel_keeps_zero_values(spark, rows):
    target, updates = frames(spark, [], [("a", "", None, 0.0, False, "")])
    assert rows(merges.upsert_hotels(target, updates, "pos")) == [("a", "", None, 0.0, False, "")]


def test_insert_reviews(spark, rows):
    shape = "source string, source_review_id string, review_text string"
    target = spark.createDataFrame([("g", "1", "old")], shape)
    updates = spark.createDataFrame(
        [(1, "g", "1", "again"), (2, "g", "2", "first"), (3, "g", "2", "second"), (4, "y", "1", "other"),
         (5, "g", " ", "blank"), (6, "g", None, "blank"), (7, "g", "", "other blank")],
        "pos int, " + shape,
    )
    merged = merges.insert_reviews(target, updates, "pos")
    assert rows(merged, "review_text") == [("blank",), ("first",), ("old",), ("other blank",), ("other",)]
    assert rows(merges.insert_reviews(merged, updates, "pos")) == rows(merged)


def test_upsert_cities(spark, rows):
    shape = "iata_code string, name string, country string, airport_count int, country_codes string"
    target = spark.createDataFrame([("A", "a", "X", 1, "x")], shape)
    updates = spark.createDataFrame(
        [(1, "A", "b", "X", 0, ""), (2, "A", "c", "X", 3, ""), (3, "B", "b", "Y", 1, "y")], "pos int, " + shape
    )
    merged = merges.upsert_cities(target, updates, "pos")
    assert rows(merged) == [("A", "c", "X", 3, ""), ("B", "b", "Y", 1, "y")]
    assert rows(merges.upsert_cities(merged, updates, "pos")) == rows(merged)


def test_ratings_keep_last_even_when_null(spark, rows):
    columns = list(merges.RATING_COLUMNS.values())
    target = spark.createDataFrame([("h", 1.0, 2.0), ("i", 1.0, 2.0)], "hotel_id string, google_rating double, booking_rating double").withColumns(
        {c: F.lit(None).cast("double") for c in columns if c not in ("google_rating", "booking_rating")}
    )
    updates = spark.createDataFrame(
        [(1, "h", "google", 4.0), (2, "h", "google", None), (3, "h", "expedia", 3.0), (4, "x", "google", 5.0)],
        "pos int, hotel_id string, source string, rating double",
    )
    merged = merges.apply_ratings(target, updates, "pos")
    assert rows(merged, "hotel_id", "google_rating", "booking_rating", "expedia_rating") == [
        ("h", None, 2.0, 3.0), ("i", 1.0, 2.0, None)
    ]


@pytest.mark.parametrize("job", ["v1", "v2"])
def test_photo_refresh_and_blanks(spark, rows, job):
    items = spark.createDataFrame(
        [(1, "A", "old"), (2, "B", "old"), (3, "C", "old")], "id int, hotel_name string, photo_name string"
    )
    reviews = spark.createDataFrame([("1", "old"), ("2", "old"), ("9", "old")], "hotel_id string, photo_name string")
    photos = spark.createDataFrame(
        [(1, "A", "1", "new"), (2, "B", "2", "x"), (3, "B", "2", ""), (4, "A", "9", "newer")],
        "pos int, hotel_name string, hotel_id string, photo_name string",
    )
    if job == "v1":
        got = rows(merges.refresh_photos_v1(items, photos, "pos", "hotel_name"), "id", "photo_name")
        assert got == [(1, "newer"), (2, ""), (3, "old")]
    else:
        by_id, by_name = merges.refresh_photos_v2(reviews, items, photos, "pos")
        assert rows(by_name, "id", "photo_name") == [(1, "newer"), (2, "old"), (3, "old")]
        # Namesakes share the photo of their name.
        assert rows(by_id) == [("1", "newer"), ("2", "old"), ("9", "newer")]
