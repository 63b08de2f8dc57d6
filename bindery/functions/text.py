"""Text: slugs, trimming, XML escapes, and codes of the formats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Kinds of navigation entries by their other names.
KIND_SYNONYMS = {"copyright": "copyright-page", "text": "bodymatter", "title-page": "titlepage", "": "unknown"}


def trimmed(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def slug(x: Column) -> Column:
    """Small ASCII letters and digits with single dashes between."""
    return F.btrim(F.regexp_replace(F.translate(x, _UPPER, _LOWER), "[^a-z0-9]+", "-"), F.lit("-"))


def entry_id(x: Column) -> Column:
    """A slug of at most 50 characters that may serve as an XML id."""
    short = F.rtrim(F.left(slug(x), F.lit(50)), F.lit("-"))
    return F.regexp_replace(F.regexp_replace(short, "^$", "entry"), "^([0-9])", "_$1")  # each step once, not once for each branch


def xml_escape(x: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"), ("\t", "&#9;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\u00a0", "&#160;")):
        x = F.replace(x, F.lit(raw), F.lit(safe))
    return x


def toc_kind(x: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in KIND_SYNONYMS.items() for v in pair])
    return F.coalesce(F.try_element_at(table, x), x)


def properties(x: Column) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


def has_property(x: Column, token: str) -> Column:
    return F.array_contains(properties(x), token)


def insert_property(x: Column, token: str) -> Column:
    """Added at the end unless it is there."""
    return F.when(has_property(x, token), x).otherwise(F.concat(F.when(x == "", "").otherwise(F.concat(x, F.lit(" "))), F.lit(token)))


def remove_property(x: Column, token: str) -> Column:
    return F.array_join(F.filter(F.split(x, " "), lambda t: t != token), " ")


def attribute(attributes: Column, name: str) -> Column:
    """The value of the first attribute of this name in array<struct<name, value>>."""
    return F.get(F.filter(attributes, lambda a: a["name"] == name), F.lit(0))["value"]


def named(pairs: Column, name: str, field: str = "value") -> Column:
    """The value of the first pair of this name, whatever the value's field is called: attributes (value) and prefixes (uri)."""
    return F.get(F.filter(pairs, lambda a: a["name"] == name), F.lit(0))[field]


def has_named(pairs: Column, name: str) -> Column:
    return F.exists(pairs, lambda a: a["name"] == name)


def insert_named(pairs: Column, name: str, value: Column, field: str = "value") -> Column:
    """With the pair: in the place of one of its name, else at the end."""
    one = F.struct(F.lit(name).alias("name"), value.alias(field))
    put = F.transform(pairs, lambda a: F.when(a["name"] == name, one).otherwise(a))
    return F.when(has_named(pairs, name), put).otherwise(F.concat(pairs, F.array(one)))


def retain_named(pairs: Column, keep: Callable[[Column], Column]) -> Column:
    """The pairs for which ``keep`` holds; what it does not hold for is what ``extract`` and ``drain`` give."""
    return F.filter(pairs, lambda a: F.coalesce(keep(a), F.lit(False)))


def remove_named(pairs: Column, name: str) -> Column:
    return retain_named(pairs, lambda a: a["name"] != name)


def direction(x: Column) -> Column:
    return F.when(x.isin("ltr", "rtl"), x).otherwise("auto")


def page_direction(x: Column) -> Column:
    return F.when(x.isin("ltr", "rtl"), x).otherwise("default")
