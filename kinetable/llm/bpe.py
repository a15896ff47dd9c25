"""Byte-level BPE encoding and decoding of whole texts.

Two tiers: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a
vocabulary entry; any other pre-token is merged with a heap of ranked pairs over doubly linked
pieces, O(n log n) in its length.  Distinct pre-tokens are resolved once per worker (a cache of
bounded size); nothing is shuffled.  Null text is empty text and gives no ids; rows, repeated
ones too, give one result row each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinetable.llm.common import hash_strings, ids_and_text, map_columns, mixed

CACHE_ENTRIES = 300_000
STRIDE = np.uint64(0xD1B54A32D192ED03)


class MinimalPerfectHash:
    """Hash and displace: n keys onto the slots 0..n-1; ``slots`` needs a check against the key."""

    def __init__(self, keys: list[bytes], shift: np.ndarray | None = None):
        n = self.n = max(1, len(keys))
        h = hash_strings(keys)
        if len(np.unique(h)) != len(keys):
            raise ValueError("keys repeat or their hashes collide")
        self.buckets = max(1, n // 3)
        if shift is not None:
            self.shift = shift
            return
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        begin = np.cumsum(sizes) - sizes
        taken = np.zeros(n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            size = int(sizes[b])
            if size == 0:
                break
            if size == 1:
                singles.append(b)
                continue
            members = order[begin[b] : begin[b] + size]
            d = 0
            while True:
                slots = self._slot(h[members], np.int64(d))
                if not taken[slots].any() and len(set(slots.tolist())) == size:
                    break
                d += 1
                if d > 50 * n:
                    raise RuntimeError("no displacement found")
            taken[slots] = True
            self.shift[b] = d
        # a bucket of one key names its slot outright, as a negative number
        self.shift[singles] = -1 - np.flatnonzero(~taken)[: len(singles)]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(33)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mixed(h + d.astype(np.uint64) * STRIDE) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = hash_strings(keys)
        d = self.shift[self._bucket(h)]
        return np.where(d < 0, -1 - d, self._slot(h, d))


class Codec:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, shift: np.ndarray | None = None):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        words = list(ranks)
        self.table = MinimalPerfectHash(words, shift)
        slots = self.table.slots(words)
        self.word_at = [b""] * self.table.n
        self.rank_at = [0] * self.table.n
        for w, s in zip(words, slots.tolist()):
            self.word_at[s] = w
            self.rank_at[s] = ranks[w]
        self.bytes_of = {str(r): w for w, r in ranks.items()}
        self.known: dict[str, str] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties, until no adjacent pair has a rank."""
        n, ranks = len(piece), self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, length = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != length:
                continue  # one of its two parts has been merged since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (k := before[i]) >= 0 and (r := ranks.get(parts[k] + parts[i])) is not None:
                heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[i])))
        return [ranks[p] for p in parts if p is not None]

    def resolve(self, pieces: list[str]) -> None:
        """Put the ids of distinct pre-tokens into the cache."""
        keys = [p.encode() for p in pieces]
        for piece, key, slot in zip(pieces, keys, self.table.slots(keys).tolist()):
            if self.word_at[slot] == key:
                self.known[piece] = str(self.rank_at[slot])
            else:
                self.known[piece] = " ".join(map(str, self.merge(key)))

    def encode_joined(self, text: str) -> str:
        """Decimal ids, joined by one space."""
        pieces = self.split(text)
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        if fresh := set(pieces).difference(self.known):
            self.resolve(list(fresh))
        return " ".join([self.known[p] for p in pieces])

    def encode(self, text: str) -> list[int]:
        joined = self.encode_joined(text)
        return [int(x) for x in joined.split(" ")] if joined else []

    def decode_joined(self, joined: str) -> bytes:
        return b"".join([self.bytes_of[x] for x in joined.split(" ")]) if joined else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[str(i)] for i in ids])


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str, shift=None) -> Codec:
    """One codec a process; the vocabulary bounds its size.  ``shift``: a broadcast of the hash's displacements."""
    if (path, pattern) not in _CODECS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _CODECS[path, pattern] = Codec(ranks, pattern, None if shift is None else shift.value)
    return _CODECS[path, pattern]


def _shared(df: DataFrame, path: str, pattern: str):
    """The displacements, found once; as many numbers as the vocabulary has buckets."""
    return df.sparkSession.sparkContext.broadcast(codec(path, pattern).table.shift)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text: ``doc_id, ids array<int>``."""

    def run(cols):
        c = codec(path, pattern, shift)
        return {"doc_id": cols["doc_id"], "ids": [c.encode(t or "") for t in cols["text"]]}

    shift = _shared(docs, path, pattern)
    rows = ids_and_text(docs, id_col, text_col)
    return map_columns(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of ``doc_id, ids``: ``doc_id, data binary``; null ids give null."""

    def run(cols):
        c = codec(path, pattern, shift)
        return {"doc_id": cols["doc_id"], "data": [None if i is None else c.decode(i) for i in cols["ids"]]}

    shift = _shared(tokens, path, pattern)
    return map_columns(tokens.select("doc_id", "ids"), run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and return counts and digests of both, without moving the ids."""

    def run(cols):
        c = codec(path, pattern, shift)
        n, ids, data = [], [], []
        for text in cols["text"]:
            joined = c.encode_joined(text or "")
            n.append(joined.count(" ") + 1 if joined else 0)
            ids.append(hashlib.sha256(joined.encode()).hexdigest())
            data.append(hashlib.sha256(c.decode_joined(joined)).hexdigest())
        return {"doc_id": cols["doc_id"], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": data}

    shift = _shared(docs, path, pattern)
    rows = ids_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows, run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded_sha256`` of every text."""
    shift = _shared(docs, path, pattern)

    def run(cols):
        c = codec(path, pattern, shift)
        joined = [c.encode_joined(t or "") for t in cols["text"]]
        ids = np.array(" ".join(j for j in joined if j).split(), np.int32)
        n = np.array([j.count(" ") + 1 if j else 0 for j in joined], np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
        digest = lambda data: hashlib.sha256(data).hexdigest()
        return {
            "doc_id": cols["doc_id"], "n_tokens": n, "ids": lists,
            "ids_sha256": [digest(j.encode()) for j in joined], "decoded_sha256": [digest(c.decode_joined(j)) for j in joined],
        }

    rows = ids_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows, run, f"doc_id {kind}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")
