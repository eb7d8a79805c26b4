import datetime as dt
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.functions import dates, text, vectors


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x"))).head()[0]


@pytest.mark.parametrize(
    "raw, want",
    [(" a ", "a"), ("\t\n a b 　", "a b"), ("", ""), ("  ", ""), (None, None), ("x", "x")],
)
def test_trim_ws(spark, raw, want):
    assert one(spark, raw, text.trim_ws) == want


def test_text_hash_ignores_case_and_spaces(spark):
    want = one(spark, "great stay", text.text_hash)
    for same in ("Great  Stay", " great\n\tstay ", "GREAT STAY "):
        assert one(spark, same, text.text_hash) == want
    # A no-break space inside the text is not collapsed.
    assert one(spark, "great stay", text.text_hash) != want


def test_parts(spark):
    assert one(spark, "Paris, France", text.first_part) == "Paris"
    assert one(spark, "Paris", text.first_part) == "Paris"
    assert one(spark, ",France", text.first_part) is None
    assert one(spark, "Austin, Texas, USA", text.last_part) == "USA"
    assert one(spark, "Paris,France", text.last_part) is None
    assert one(spark, None, text.last_part) is None


def test_lenient_numbers(spark):
    assert one(spark, "+12", text.parse_int) == 12
    for bad in ("12.0", "", "x", "1d", "99999999999999999999"):
        assert one(spark, bad, text.parse_int) is None
    assert one(spark, " -1.5e2 ", text.parse_float) == -150.0
    for bad in ("1d", "NaN", "north", "."):
        assert one(spark, bad, text.parse_float) is None


def test_slug_and_stars(spark):
    assert one(spark, " The Inn & Café #2 ", text.file_slug) == "the_inn__caf_2"
    assert one(spark, "4 star rating", text.star_rating) == 4.0
    assert one(spark, "no stars", text.star_rating) == 0.0


def test_prompt_values(spark):
    assert one(spark, 4.0, text.plain_number, "double") == "4"
    assert one(spark, 4.5, text.plain_number, "double") == "4.5"
    assert one(spark, None, text.plain_value) == "<nil>"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2023-10-15T12:00:00Z", "2023-10-15 12:00:00"),
        ("2023-10-15T12:00:00.25+02:00", "2023-10-15 10:00:00.25"),
        ("2023-10-15", "2023-10-15 00:00:00"),
        ("Oct 5, 2023", "2023-10-05 00:00:00"),
        ("oct 15, 2023", "2023-10-15 00:00:00"),
        ("2023-10-15 01:02:03", "2023-10-15 01:02:03"),
        ("Oct  5 2023", "2023-10-05 00:00:00"),
        (" Oct 15 2023 ", "2023-10-15 00:00:00"),
        ("October 15, 2023", None),
        ("15/10/2023", None),
        ("", None),
    ],
)
def test_absolute_dates(spark, raw, want):
    got = one(spark, raw, dates.absolute_date)
    assert got == (dt.datetime.fromisoformat(want) if want else None)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("1 day ago", "2024-03-30T10:30"),
        ("2 Weeks AGO", "2024-03-17T10:30"),
        # February has no 31st day; the date rolls into March.
        ("1 month ago", "2024-03-02T10:30"),
        ("13 months ago", "2023-03-03T10:30"),
        ("1 year ago", "2023-03-31T10:30"),
        ("a week ago", None),
        ("3 moons ago", None),
        ("ago", None),
    ],
)
def test_relative_dates(spark, raw, want):
    as_of = F.lit("2024-03-31 10:30:00").cast("timestamp")
    got = one(spark, raw, lambda c: dates.review_date(c, as_of))
    assert got == (dt.datetime.fromisoformat(want) if want else None)


def test_normalise_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "id int, embedding array<float>")
    got = {r.id: r.embedding for r in vectors.l2_normalise(df).collect()}
    assert got[1] == pytest.approx([0.6, 0.8])
    assert got[2] == [0.0, 0.0]


def test_hashing_embedder_has_unit_length(spark):
    df = spark.createDataFrame(list(enumerate(["a b a", "", None, "B  A a"])), "i int, t string")
    rows = vectors.hashing_embedder(16).transform(df, "t", "e").orderBy("i").collect()
    out = np.array([r.e for r in rows])
    assert np.linalg.norm(out[0]) == pytest.approx(1)
    assert not out[1].any() and not out[2].any()
    assert out[0] == pytest.approx(out[3])


@pytest.mark.parametrize("dim", [16, 64, 48, 1 << 20])
def test_hashing_embedder_places_words_by_md5(spark, dim):
    df = spark.createDataFrame([("Quiet rooms, quiet street",)], "t string")
    got = vectors.hashing_embedder(dim).transform(df, "t", "e").head().e
    want = np.zeros(dim)
    for word in ("quiet", "rooms,", "quiet", "street"):
        want[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim] += 1
    assert got == pytest.approx(want / np.linalg.norm(want))
