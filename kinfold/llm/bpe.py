"""Byte-level BPE with a segment tree over byte positions: its root is the leftmost pair of least rank."""

from __future__ import annotations

import base64
import gc
import hashlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.common import stash_texts, whole_row

#: Pieces up to this many bytes are merged many at a time; longer ones alone.
WIDE = 64
#: Encoded pieces that a worker remembers, at most, and their characters: beyond either it starts anew before the next texts.
REMEMBERED = 250_000
REMEMBERED_CHARS = 4_000_000
NO_PAIR = 1 << 60


class Vocabulary:
    """Tokens by id, and for each mergeable pair of ids the merged id; a rank is an id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.shown = [str(k) for k in range(len(self.tokens))]
        #: One int object per id, shared by all lists of ids.
        self.ids = list(range(len(self.tokens)))
        self.byte = np.array([self.ranks[bytes([k])] for k in range(256)], dtype=np.int64)
        self.merged = {}
        get = self.ranks.get
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    self.merged[a << 20 | b] = rank
        self._hash()

    def _hash(self) -> None:
        """The same map as open addressing in arrays, for many lookups at a time."""
        self.bits = max(4, (4 * len(self.merged)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, NO_PAIR, dtype=np.int64)
        key, value = np.array(list(self.merged), dtype=np.int64), np.array(list(self.merged.values()), dtype=np.int64)
        slot = self._slot(key)
        self.probes = 0
        while len(key):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            done = self.keys[slot] == key
            self.values[slot[done]] = value[done]
            key, value, slot = key[~done], value[~done], (slot[~done] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); NO_PAIR where they don't merge or a side is absent (-1)."""
        out = np.full(len(a), NO_PAIR, dtype=np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = a[todo] << 20 | b[todo]
        slot = self._slot(key)
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one piece. Tree nodes hold rank * 2^32 + position; a merge updates three leaves' paths."""
        n = len(piece)
        ids, after, before = self.byte[np.frombuffer(piece, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merged.get
        size = 1 << max(0, (n - 1).bit_length())
        tree = [NO_PAIR] * (2 * size)
        for k in range(n - 1):
            r = get(ids[k] << 20 | ids[k + 1])
            if r is not None:
                tree[size + k] = r << 32 | k
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(at: int, value: int) -> None:
            k = size + at
            tree[k] = value
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        def pair(at: int) -> int:
            other = after[at]
            r = get(ids[at] << 20 | ids[other]) if other < n else None
            return NO_PAIR if r is None else r << 32 | at

        while (top := tree[1]) != NO_PAIR:
            at = top & 0xFFFFFFFF
            gone = after[at]
            ids[at] = top >> 32
            after[at] = after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            put(gone, NO_PAIR)
            put(at, pair(at))
            if before[at] >= 0:
                put(before[at], pair(before[at]))
            ids[gone] = -1
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of pieces of at most ``WIDE`` bytes: one tree each, side by side; every round merges once in each live piece."""
        out: list[list[int]] = [[] for _ in pieces]
        by_width = defaultdict(list)
        for k, p in enumerate(pieces):
            by_width[max(2, 1 << (len(p) - 1).bit_length())].append(k)
        for width, places in by_width.items():
            for s in range(0, len(places), 8192):
                part = places[s : s + 8192]
                for k, ids in zip(part, self._merge_block([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _merge_block(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n = len(pieces)
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < length[:, None], self.byte[raw], -1)
        after = np.broadcast_to(at + 1, (n, width)).copy()
        before = np.broadcast_to(at - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NO_PAIR, dtype=np.int64)
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        tree[:, width : 2 * width - 1] = np.where(rank < NO_PAIR, rank << 8 | at[:-1], NO_PAIR)
        for lo in [width >> k for k in range(1, width.bit_length())]:
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])

        def put(rows: np.ndarray, cols: np.ndarray, values: np.ndarray) -> None:
            node = width + cols
            tree[rows, node] = values
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        def pair(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
            other = after[rows, cols]
            r = self.rank_of(ids[rows, cols], np.where(other < width, ids[rows, np.minimum(other, width - 1)], -1))
            return np.where(r < NO_PAIR, r << 8 | cols, NO_PAIR)

        live = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(live):
            top = tree[live, 1]
            col = top & 255
            gone = after[live, col]
            ids[live, col] = top >> 8
            nxt = after[live, gone]
            after[live, col] = nxt
            ids[live, gone] = -1
            has = nxt < width
            before[live[has], nxt[has]] = col[has]
            put(live, gone, np.full(len(live), NO_PAIR))
            put(live, col, pair(live, col))
            left = before[live, col]
            has = left >= 0
            if has.any():
                put(live[has], left[has], pair(live[has], left[has]))
            live = live[tree[live, 1] < NO_PAIR]
        return [row[row >= 0].tolist() for row in ids]


class _Known(dict):
    """Ids by piece; asking for an unknown piece gives it an empty list and notes it down to be filled."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[tuple[str, list[int]]] = []
        self.chars = 0

    def __missing__(self, piece: str) -> list[int]:
        ids: list[int] = []
        self[piece] = ids
        self.new.append((piece, ids))
        self.chars += len(piece)
        return ids


class Encoder:
    """Texts to ids and back, with a bounded memory of encoded pieces."""

    def __init__(self, path: str, pattern: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pieces = regex.compile(pattern).findall
        self.known = _Known()

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text: every match of the pattern that is a token is that token, any other is merged from bytes."""
        if len(self.known) > REMEMBERED or self.known.chars > REMEMBERED_CHARS:
            self.known = _Known()
        watching = gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            known = self.known
            found = [list(map(known.__getitem__, self.pieces(t))) for t in texts]
            self._fill(known)
            return [list(chain.from_iterable(x)) for x in found]
        finally:
            if watching:
                gc.enable()

    def _fill(self, known: _Known) -> None:
        ranks, short, one = self.vocabulary.ranks, [], self.vocabulary.ids.__getitem__
        for p, ids in known.new:
            raw = p.encode("utf-8", "replace")
            whole = ranks.get(raw)
            if whole is not None:
                ids.append(whole)
            elif len(raw) <= WIDE:
                short.append((raw, ids))
            else:
                ids += map(one, self.vocabulary.merge_one(raw))
        for (_, ids), merged in zip(short, self.vocabulary.merge_many([raw for raw, _ in short]), strict=True):
            ids += map(one, merged)
        known.new = []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, pattern)


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _batches(texts: pa.Array, most: int = 1 << 20):
    """Lists of texts of about ``most`` characters; a null text is empty."""
    part, size = [], 0
    for t in texts:
        x = t.as_py() or ""
        part.append(x)
        size += len(x)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def with_token_ids(docs: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with ``out``: the ids of the whole text (null: of the empty text). The vocabulary file is read on each executor; the result is written once."""
    path, pattern = (path, pattern) if path and pattern else _default()

    def of(texts: pa.Array) -> pa.Array:
        found = chain.from_iterable(encoder(path, pattern).encode_many(b) for b in _batches(texts))
        return pa.array(list(found), pa.list_(pa.int32()))

    ids = F.arrow_udf(of, "array<int>")(F.col(text))
    found = stash_texts(docs.select(whole_row(docs).alias("row"), ids.alias("found")), "token-ids")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != out.lower()], F.col("found").alias(out))


def digests(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` per document: the text is encoded, and the ids decoded again.

    A null text counts as empty: no tokens, and the hashes of the empty string. Repeated rows give repeated rows.
    """
    path, pattern = (path, pattern) if path and pattern else _default()

    def of(texts: pa.Array) -> pa.Array:
        coder = encoder(path, pattern)
        n, ids_hash, text_hash = [], [], []
        for part in _batches(texts):
            for ids in coder.encode_many(part):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join(map(coder.vocabulary.shown.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    found = F.arrow_udf(of, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>")(F.col(text))
    return stash_texts(docs.select("doc_id", found.alias("found")), "token-digests").select("doc_id", "found.*")
