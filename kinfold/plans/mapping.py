"""Header mapping: which canonical target each column of a source stands for. Works on names only, never on data."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import SAMPLE_NULL_LITERALS, is_blank
from kinfold.plans.vocabulary import FIELDS, HEADER_SYNONYMS

UNMAPPED = "unmapped"
# Tokens that tell nothing about a header, tokens of activity columns, targets that are names, and
# targets that no id column stands for.
GENERIC = frozenset((
    "user", "id", "no", "number", "code", "val", "data", "txt", "date", "time", "day", "year", "month", "account", "balance", "total", "amount", "is", "has", "flag", "status", "type", "info", "memo",
    "note", "notes", "desc", "description", "item", "record", "entry", "member", "last", "first", "home", "social", "screen", "profile",
))
ACTIVITY = frozenset(("active", "seen", "login", "activity", "updated", "timestamp", "last_active", "last_seen", "last_login"))
NAMES = frozenset(("name", "first_name", "last_name", "business_name"))
NOT_BY_ID = frozenset(("phone", "email", "name", "address", "company", "city", "username"))
ACCEPT = 0.75


@dataclass(frozen=True)
class Proposal:
    raw_column: str
    suggested_canonical: str
    confidence: float
    reason: str
    is_approved: bool = False
    is_ambiguous: bool = False


class MappingProvider(Protocol):
    """Anything that proposes targets for a source's columns."""

    def propose(self, columns: Iterable[str]) -> dict[str, Proposal]: ...


def slug(name: str | None) -> str:
    """A header in lower case with single underscores between its tokens."""
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]+", "_", str(name or "").strip().lower())).strip("_")


def indel_ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over the total length; 100 for equal names."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_score(shared: set[str], own: set[str], other: set[str]) -> float:
    """A score in bands of the Jaccard overlap of two token sets."""
    overlap = len(shared) / len(own | other)
    slope, base = next((s, b) for least, s, b in ((0.8, 0.10, 0.85), (0.5, 0.15, 0.70), (0.0, 0.30, 0.35)) if overlap >= least)
    return base + slope * overlap


class HeaderMapper:
    """The deterministic provider: exact names first, then scored likeness to the synonyms."""

    def __init__(self, synonyms: Mapping[str, Sequence[str]] | None = None) -> None:
        self.synonyms = HEADER_SYNONYMS if synonyms is None else synonyms
        self._seen: dict[tuple[str, ...], dict[str, Proposal]] = {}

    def _scored(self, name: str) -> tuple[str, float, str]:
        """The best target by tokens, likeness or containment; the first of equals."""
        own = set(name.split("_"))
        telling = own - GENERIC
        best = (UNMAPPED, 0.0, "")
        for target, synonyms in self.synonyms.items():
            for synonym in synonyms:
                other = set(synonym.split("_"))
                found = []
                if common := telling & (other - GENERIC):
                    found.append((token_score(own & other, own, other), f"shares '{min(common)}' with '{synonym}'"))
                like = indel_ratio(name, synonym)
                if like >= 85 and telling:
                    found.append((round(like / 100, 2), f"reads like '{synonym}'"))
                elif self._contains(name, target, synonym):
                    found.append((0.75 + min(0.10, 0.01 * len(synonym)), f"contains '{synonym}'"))
                for score, why in found:
                    if score > best[1]:
                        best = (target, score, why)
        return best

    @staticmethod
    def _contains(name: str, target: str, synonym: str) -> bool:
        if len(synonym) < 5 or synonym in GENERIC or not (synonym in name or name in synonym):
            return False
        is_id = name == "id" or name.endswith("_id")
        return not ((is_id and target in NOT_BY_ID) or (target in NAMES and synonym in ("last", "first", "name")) or (target == "username" and name in ("uid", "userid")))

    @staticmethod
    def _by_head(name: str) -> tuple[str, float, str] | None:
        """Compounds whose last word says what they are."""
        head = name.rsplit("_", 1)[-1]
        for target, heads, score in (("sku", ("sku",), 0.85), ("barcode", ("barcode", "upc", "ean", "gtin"), 0.85), ("price", ("price", "cost", "msrp"), 0.85), ("name", ("title",), 0.80)):
            if head in heads and not (head == "title" and name.endswith("job_title")):
                return target, score, f"last word '{head}'"
        return None

    def propose_one(self, column: str) -> Proposal:
        """The proposal for one header, without regard to the others."""
        name = slug(column)
        if not name:
            return Proposal(column, UNMAPPED, 0.0, "empty name")
        if name in self.synonyms:
            return Proposal(column, name, 1.0, f"is the target '{name}'")
        for target, synonyms in self.synonyms.items():
            if name in synonyms:
                return Proposal(column, target, 1.0, f"'{name}' is a name of '{target}'")
        if (set(name.split("_")) - GENERIC) & ACTIVITY:
            return Proposal(column, UNMAPPED, 0.0, "activity or time column")
        target, score, why = self._scored(name)
        if score < ACCEPT:
            target, score, why = self._by_head(name) or (UNMAPPED, 0.0, "nothing alike")
        if target == "username" and (name.endswith("_id") or name in ("uid", "userid")):
            target, score, why = "uid", 0.9, "an id, not a name"
        return Proposal(column, target, score, why)

    def propose(self, columns: Iterable[str]) -> dict[str, Proposal]:
        """Proposals for a table, one winner per target; kept by column list."""
        key = tuple(columns)
        if key not in self._seen:
            self._seen[key] = self.resolve_collisions({c: self.propose_one(c) for c in key})
        return dict(self._seen[key])

    def resolve_collisions(self, proposals: dict[str, Proposal]) -> dict[str, Proposal]:
        """The strongest column keeps a contested target; all contestants are flagged, the others left unmapped."""
        by_target = defaultdict(list)
        for column, p in proposals.items():
            if p.suggested_canonical != UNMAPPED:
                by_target[p.suggested_canonical].append(column)
        out = dict(proposals)
        for target, columns in by_target.items():
            if len(columns) < 2:
                continue

            def strength(column: str, target: str = target) -> tuple:
                name = slug(column)
                return name == target, name in self.synonyms.get(target, ()), out[column].confidence, -len(name), name

            winner = max(columns, key=strength)
            for column in columns:
                p = replace(out[column], is_ambiguous=True)
                out[column] = p if column == winner else replace(p, suggested_canonical=UNMAPPED, confidence=0.5, reason=f"'{winner}' stands for '{target}'")
        return out


def validate(mapping: dict[str, str], columns: Iterable[str]) -> list[str]:
    """What is wrong with a mapping; an empty list if nothing is."""
    known, seen, errors = set(columns), set(), []
    for column, target in mapping.items():
        if column not in known:
            errors.append(f"column '{column}' is not in the source")
        if target == UNMAPPED:
            continue
        if target not in FIELDS:
            errors.append(f"'{target}' is not a canonical field")
        if target in seen:
            errors.append(f"several columns stand for '{target}'")
        seen.add(target)
    if not any(FIELDS[t].is_identifier for t in seen if t in FIELDS):
        errors.append("no identifier is mapped")
    return errors


def compatibility(mappings: dict[str, dict[str, str]]) -> tuple[bool, list[str]]:
    """Whether some pair of datasets shares an identifier (a single dataset always does), and all that are shared."""
    if len(mappings) < 2:
        return True, []
    holders = defaultdict(set)
    for dataset, mapping in mappings.items():
        for target in mapping.values():
            if target in FIELDS and FIELDS[target].is_identifier:
                holders[target].add(dataset)
    shared = sorted(t for t, d in holders.items() if len(d) > 1)
    return bool(shared), shared


def sample_row(df: DataFrame) -> list[tuple[str, str | None]]:
    """One value per column from the first row that has any; no such row, no samples."""
    if not df.columns:
        return []
    texts = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    some = [~is_blank(F.col(f"`{c}`"), SAMPLE_NULL_LITERALS) for c in df.columns]
    found = df.select(*texts).where(F.array_contains(F.array(*some), True)).limit(1).collect()
    return list(found[0].asDict().items()) if found else []


def select_columns(proposals: dict[str, Proposal], show: str = "all", part: str = "") -> list[str]:
    """Columns of a table to look at: ``all``, ``review`` (flagged), ``mapped`` or ``unmapped``, whose names hold ``part``."""
    tests = {"all": lambda p: True, "review": lambda p: p.is_ambiguous, "mapped": lambda p: p.suggested_canonical != UNMAPPED, "unmapped": lambda p: p.suggested_canonical == UNMAPPED}
    return [c for c, p in proposals.items() if tests[show](p) and part.strip().lower() in c.lower()]


def previews(df: DataFrame, rows: int = 3) -> dict[str, list[str]]:
    """The first ``rows`` filled values of each column of the whole table, in the order in which it is read.

    Values are numbered as they are read; a column's first value is a minimum, its next the minimum beyond it, so a
    pass over the table gives one value of every column and gathers nothing.
    """
    if not df.columns:
        return {}
    value = {c: F.col(f"`{c}`").cast("string") for c in df.columns}
    numbered = df.select(F.monotonically_increasing_id().alias("at"), F.struct(*[F.when(~is_blank(v), v).alias(c) for c, v in value.items()]).alias("row"))
    out: dict[str, list[str]] = {c: [] for c in df.columns}
    last = dict.fromkeys(df.columns, -1)
    while open_ := [c for c in df.columns if len(out[c]) < rows and last[c] is not None]:
        first = [F.min(F.when((F.col("at") > last[c]) & F.col("row")[c].isNotNull(), F.struct("at", F.col("row")[c].alias("v")))).alias(str(k)) for k, c in enumerate(open_)]
        for c, found in zip(open_, numbered.agg(*first).first(), strict=True):
            last[c] = found["at"] if found else None
            out[c] += [found["v"]] if found else []
    return out
