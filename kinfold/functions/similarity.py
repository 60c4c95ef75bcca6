"""String similarities between 0 and 1. Comparison is of stripped lower-case text; blanks are like nothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.text import strip


def _plain(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit(""))))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    x, y = _plain(a), _plain(b)
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def tokens(c: Column) -> Column:
    """The distinct word tokens of a text."""
    return F.array_distinct(F.regexp_extract_all(_plain(c), F.lit(r"(?U)\w+"), F.lit(0)))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct word tokens."""
    x, y = tokens(a), tokens(b)
    union = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def exact(a: Column, b: Column) -> Column:
    """1.0 if equal and a value at all."""
    x, y = _plain(a), _plain(b)
    none = x.isin("", "nan", "none") | y.isin("", "nan", "none")
    return F.when(~none & (x == y), 1.0).otherwise(0.0)


def soundex_equal(a: Column, b: Column) -> Column:
    """1.0 if the two sound alike by their Soundex codes."""
    return exact(F.soundex(strip(a)), F.soundex(strip(b)))


def year_match(a: Column, b: Column) -> Column:
    """1.0 if both begin with the same four characters."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    return F.when((F.length(x) >= 4) & (F.length(y) >= 4) & (x.substr(1, 4) == y.substr(1, 4)), 1.0).otherwise(0.0)


#: Texts up to this length are compared in the batch's arrays; longer ones pair by pair, so that one does not widen all.
_WIDE = 64


def _codes(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of each text as numbers in a row of equal width, 0 beyond its end, and the lengths."""
    held = np.asarray(texts, dtype=str)
    width = max(1, held.dtype.itemsize // 4)
    return held.view(np.uint32).reshape(len(held), width), np.char.str_len(held)


def _jaro_winkler(x: np.ndarray, y: np.ndarray, weight: float = 0.1, longest: int = 4) -> np.ndarray:
    """Jaro similarity raised by the common prefix, whatever its size, of many pairs of non-empty texts at once.

    A character matches the first free equal one within half the longer length; half transpositions count half.
    """
    (a, n), (b, m) = _codes(x), _codes(y)
    rows, reach = np.arange(len(a)), np.maximum(n, m) // 2 - 1
    place = np.arange(b.shape[1])
    free = place < m[:, None]
    partner = np.full(a.shape, -1)
    for i in range(a.shape[1]):
        fits = free & (b == a[:, i, None]) & (np.abs(place - i) <= reach[:, None]) & (i < n)[:, None]
        at = fits.argmax(axis=1)
        hit = fits[rows, at]
        free[rows[hit], at[hit]] = False
        partner[hit, i] = at[hit]
    mine = partner >= 0
    matched = mine.sum(axis=1)
    # Matched characters of both sides, each in its own order.
    left = np.take_along_axis(a, np.argsort(~mine, axis=1, kind="stable"), axis=1)
    theirs = (place < m[:, None]) & ~free
    right = np.take_along_axis(b, np.argsort(~theirs, axis=1, kind="stable"), axis=1)
    width = min(a.shape[1], b.shape[1])
    swapped = ((left[:, :width] != right[:, :width]) & (np.arange(width) < matched[:, None])).sum(axis=1)
    some = np.maximum(matched, 1)
    jaro = np.where(matched > 0, (matched / n + matched / m + (matched - swapped / 2) / some) / 3, 0.0)
    w = min(width, longest)
    prefix = np.cumprod((a[:, :w] == b[:, :w]) & (np.arange(w) < np.minimum(n, m)[:, None]), axis=1).sum(axis=1)
    return jaro + prefix * weight * (1 - jaro)


def _jaro_winkler_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.array(["" if v is None else v.replace("\0", " ").strip().lower() for v in s], dtype=object) for s in (a, b))
    out = np.zeros(len(x))
    filled = (x != "") & (y != "")
    out[filled & (x == y)] = 1.0
    todo = np.flatnonzero(filled & (x != y))
    wide = np.array([max(len(x[k]), len(y[k])) for k in todo], dtype=int)
    for part in (todo[wide <= _WIDE], *([k] for k in todo[wide > _WIDE])):
        if len(part):
            out[part] = _jaro_winkler(x[part], y[part])
    return pd.Series(out)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity of stripped lower-case texts, in Arrow batches; 1.0 for equal texts, 0.0 for blank ones."""
    return F.pandas_udf(_jaro_winkler_batch, "double")(a, b)
