"""Text keys, ids and small formatters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Character classes and patterns shared by several operators.
WHITE = r"(?U)\s"
WHITE_CHARS = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)
HASH_SPACES = r"[\t\n\f\r ]+"
FIRST_PART = r"^[^,]+"
LAST_PART = r", ([^,]+)\z"
STAR_RATING = r"(\d+) star"
BIZ_LINK = r'href="(/biz/[^"]+)"'
BIZ_HOST = "https://www.yelp.com"
LIST_HOTEL_ID = r"-d(\d+)-"
INTEGER = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def trim_ws(c: Column) -> Column:
    """Trim every white-space character, not only U+0020."""
    return F.btrim(c, F.lit(WHITE_CHARS))


def norm_key(c: Column) -> Column:
    """Join key of city names: lower case, outer white space removed."""
    return trim_ws(F.lower(c))


def text_hash(c: Column) -> Column:
    """Hash of a text up to case and runs of white space."""
    return F.md5(trim_ws(F.regexp_replace(F.lower(c), HASH_SPACES, " ")))


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_part(c: Column) -> Column:
    """Text before the first comma, NULL when there is none."""
    return null_if_empty(F.regexp_extract(c, FIRST_PART, 0))


def last_part(c: Column) -> Column:
    """Text after the last ", ", NULL when there is none."""
    return null_if_empty(F.regexp_extract(c, LAST_PART, 1))


def first_non_blank(*cols: Column) -> Column:
    """First argument with a visible character, trimmed; '' if all are blank."""
    return F.coalesce(*[null_if_empty(trim_ws(c)) for c in cols], F.lit(""))


def place_label(city: Column, country: Column) -> Column:
    return F.concat(city, F.lit(", "), country)


def sha_id(*parts: Column) -> Column:
    return F.sha2(F.concat(*[F.coalesce(p, F.lit("")) for p in parts]), 256)


def prefixed_id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), c)


def titled_text(title: Column, body: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def parse_int(c: Column) -> Column:
    """Integer of a plain decimal string, NULL otherwise."""
    return F.when(c.rlike(INTEGER), c.try_cast("bigint"))


def parse_float(c: Column) -> Column:
    """Double of a plain decimal string, NULL otherwise."""
    trimmed = trim_ws(c)
    return F.when(trimmed.rlike(FLOAT), trimmed.try_cast("double"))


def star_rating(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, STAR_RATING, 1).try_cast("double"), F.lit(0.0))


def first_biz_link(html: Column) -> Column:
    path = null_if_empty(F.regexp_extract(html, BIZ_LINK, 1))
    return F.concat(F.lit(BIZ_HOST), path)


def list_hotel_id(href: Column) -> Column:
    return null_if_empty(F.regexp_extract(href, LIST_HOTEL_ID, 1))


def file_slug(c: Column) -> Column:
    spaced = F.regexp_replace(trim_ws(F.lower(c)), " ", "_")
    return F.regexp_replace(spaced, "[^a-z0-9_]", "")


def fixed3(c: Column) -> Column:
    """Number with three decimals."""
    return F.format_string("%.3f", c)


def plain_value(c: Column) -> Column:
    """Text shown in prompts for a string: NULL is spelled out."""
    return F.coalesce(c.cast("string"), F.lit("<nil>"))


def plain_number(c: Column) -> Column:
    """Text shown in prompts for a double: no trailing ``.0``."""
    whole = F.when(c == F.floor(c), c.cast("bigint").cast("string"))
    return F.coalesce(whole, c.cast("string"), F.lit("<nil>"))


def word_budget_exceeded(words: Column, max_tokens: int) -> Column:
    """Rough token estimate (four tokens for five words, in integers) over budget."""
    return F.floor(words * 4 / 5) > max_tokens


def contains_yes(c: Column) -> Column:
    """A verdict counts as safe when it says yes anywhere; a missing one does not."""
    return F.coalesce(trim_ws(F.lower(c)).contains("yes"), F.lit(False))


def normalise_text(c: Column) -> Column:
    return F.array_join(words(c), " ")


def words(c: Column) -> Column:
    """White-space separated words of a text."""
    return F.array_remove(F.split(trim_ws(c), f"{WHITE}+"), "")
