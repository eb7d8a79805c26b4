"""City, country, state and postal code of formatted addresses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from staylens.functions.text import trim_ws, words

# Fixed values of the address rules.
US_NAMES = ["USA", "United States"]
AUSTRALIA = "Australia"
BRAZIL = "Brazil"
CITY_STATE = " - "
POSTAL = r"^[0-9A-Za-z]{3,10}$"
POSTAL_WITH_DIGIT = r"^(?:[A-Za-z]*[0-9])[0-9A-Za-z]*$"


def _from_end(parts: Column, n: int) -> Column:
    return F.get(parts, F.size(parts) - n)


def clean_city(c: Column, require_digit: bool = False) -> Column:
    """City without its postal token: the last token is tested, then the first.

    Any 3 to 10 ASCII letters or digits pass as a postal token unless
    ``require_digit`` asks for a digit.
    """
    tokens = words(c)
    n = F.size(tokens)

    def postal(t: Column) -> Column:
        hit = t.rlike(POSTAL)
        return hit & t.rlike(POSTAL_WITH_DIGIT) if require_digit else hit

    return (
        F.when(n == 0, c)
        .when(postal(_from_end(tokens, 1)), F.array_join(F.filter(tokens, lambda _, i: i < n - 1), " "))
        .when(postal(F.get(tokens, F.lit(0))),
              F.array_join(F.filter(tokens, lambda _, i: i > 0), " "))
        .otherwise(c)
    )


def address_parts(address: Column) -> Column:
    """Struct of city, country, state, zip; parts a rule does not set are ''."""
    parts = F.transform(F.split(F.coalesce(address, F.lit("")), ","), trim_ws)
    n = F.size(parts)
    country = _from_end(parts, 1)
    second, third = _from_end(parts, 2), _from_end(parts, 3)
    tokens = words(second)
    count = F.size(tokens)
    pair = F.split(third, CITY_STATE)

    us = country.isin(*US_NAMES)
    us_ok = us & (n >= 3) & (count >= 2)
    au = country == AUSTRALIA
    au_ok = au & (n >= 3) & (count >= 2)
    br = country == BRAZIL
    br_ok = br & (n >= 4) & (F.size(pair) >= 2)

    city = (
        F.when(us_ok, third)
        .when(au_ok, F.array_join(F.filter(tokens, lambda _, i: i < count - 2), " "))
        .when(br_ok, F.get(pair, F.lit(0)))
        .when(~us & ~au & ~br & (n >= 2), clean_city(second))
        .otherwise("")
    )
    state = (
        F.when(us_ok, F.get(tokens, F.lit(0)))
        .when(au_ok, _from_end(tokens, 2))
        .when(br_ok, F.get(pair, F.lit(1)))
        .otherwise("")
    )
    zip_code = F.when(us_ok, F.get(tokens, F.lit(1))).otherwise("")
    return F.struct(
        city.alias("city"), country.alias("country"), state.alias("state"), zip_code.alias("zip")
    )


def state_token(address: Column) -> Column:
    """First token of the second-last comma part, '' when there is none."""
    parts = F.split(address, ",")
    return F.coalesce(F.get(words(_from_end(parts, 2)), F.lit(0)), F.lit(""))
