"""Text expressions that behave alike for all of Unicode: white space, blanks, title case, decimal rests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Literals that stand for "no value", lower-cased.
NULL_LITERALS = ("", "nan", "none", "null", "undefined", "n/a", "na", "-", "<na>", "nat")
MATCH_NULL_LITERALS = ("", "nan", "none", "null", "undefined", "n/a", "na", "-")
SAMPLE_NULL_LITERALS = ("", "nan", "none", "null", "undefined", "n/a", "na")


def strip(c: Column) -> Column:
    """``c`` without white space at its ends, of any Unicode kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column, literals: tuple[str, ...] = NULL_LITERALS) -> Column:
    """True for null and for the literals that stand for no value; never null."""
    return c.isNull() | F.lower(strip(c)).isin(*literals)


def squeeze(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, r"(?U)\s+", by)


def title_case(c: Column) -> Column:
    """Every letter that follows a non-letter in upper case, the others in lower case."""
    parts = F.split(F.lower(c), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def without_decimal_rest(c: Column) -> Column:
    """A trailing ``.0`` removed, as integers that went through a float column carry."""
    return F.regexp_replace(c, r"\.0$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def native(text: Column, kind: Column) -> Column:
    """The value that :func:`shown` made text of, as a variant of its own kind: a long, a double, a boolean or the text itself."""
    number = F.when(kind == "int", text.try_cast("bigint").cast("variant")).when(kind == "float", text.try_cast("double").cast("variant"))
    return F.coalesce(number, F.when(kind == "bool", F.lower(text).try_cast("boolean").cast("variant")), text.cast("variant"))


def shown(c: Column, kind: str) -> Column:
    """The text of a native value: integral doubles with ``.0``, booleans capitalised, timestamps in ISO form."""
    if kind in ("double", "float"):
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(F.isnan(d), F.lit(None).cast("string")).when(whole, F.concat(d.cast("bigint").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return strip(c.cast("string"))
