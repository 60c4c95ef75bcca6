"""Normalisers by canonical field: text to text, '' for no value, with a validity test beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import digits, is_blank, squeeze, strip, title_case, without_decimal_rest

Rule = Callable[[Column], Column]


def _phone(s: Column) -> Column:
    d = F.regexp_replace(digits(without_decimal_rest(s)), "^00", "")
    n = F.length(d)
    return F.when((n == 12) & d.startswith("91"), d.substr(F.lit(3), n)).when((n == 11) & d.rlike("^[01]"), d.substr(F.lit(2), n)).otherwise(d)


RULES: dict[str, Rule] = {
    "email": F.lower,
    "phone": _phone,
    "aadhaar": digits,
    "sku": lambda s: F.regexp_replace(without_decimal_rest(F.upper(s)), r"(?U)[\s_]+", "-"),
    "barcode": lambda s: F.upper(F.regexp_replace(without_decimal_rest(s), "[^A-Za-z0-9]", "")),
    "username": lambda s: squeeze(F.lower(s), "_"),
    "member_id": F.upper,
    "numeric": lambda s: F.regexp_replace(s, r"^([^.]*)\.0$", "$1"),
    "name": lambda s: title_case(squeeze(s)),
}
#: Canonical fields that share a rule; any other field is only stripped.
SHARED = {
    "uid": "member_id", "first_name": "name", "last_name": "name", "business_name": "name", "address": "name", "city": "name", "company": "name",
    "rating": "numeric", "review_count": "numeric", "latitude": "numeric", "longitude": "numeric", "price": "numeric", "stock": "numeric", "followers": "numeric", "following": "numeric",
}


def normalize(c: Column, field: str) -> Column:
    """``c`` in the normal form of ``field``; null and literals for no value give ''."""
    rule = RULES.get(SHARED.get(field, field), lambda s: s)
    return F.when(is_blank(c), F.lit("")).otherwise(rule(strip(c)))


def is_valid(c: Column, field: str) -> Column:
    """Whether ``c`` normalises to a well-formed value; no value is valid."""
    s, n = normalize(c, field), F.length(normalize(c, field))
    tests = {
        "email": s.rlike(r"(?U)^[\w.-]+@[\w.-]+\.\w+$"), "phone": n.between(7, 15), "aadhaar": n >= 6, "sku": n >= 2, "barcode": n >= 4,
    }
    return is_blank(c) | tests.get(field, F.lit(True))
