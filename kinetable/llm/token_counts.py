"""Token counts of whole texts without a shuffle of pre-tokens.

Two tiers on the map side: a compact hash table with the lengths of frequent pre-tokens (those
that the vocabulary holds as whole words; its size is bounded by the vocabulary) is broadcast;
the others are encoded through a cache of bounded size in each worker.  Null text counts as
empty; strings of special tokens inside a text count as one token, the library's default.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import hash_strings, ids_and_text, map_columns

CACHE_ENTRIES = 1_000_000
#: Planes without letters, where Unicode tables differ between libraries: such texts go to the library whole.
UNASSIGNED = regex.compile("[\U000323B0-\U000DFFFF]").search
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class LengthTable:
    """Open addressing over 64-bit hashes: keys, and a byte with the length for each."""

    def __init__(self, words: list[bytes], lengths: list[int]):
        self.bits = max(4, (2 * len(words)).bit_length())
        size = 1 << self.bits
        self.keys, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint8)
        hashes = hash_strings(words)
        if len(np.unique(hashes)) != len(words) or (hashes == 0).any():
            raise ValueError("hashes of frequent pre-tokens collide")
        for h, at, n in zip(hashes, self._home(hashes).tolist(), lengths):
            while self.keys[at]:
                at = (at + 1) & (size - 1)
            self.keys[at], self.lengths[at] = h, n

    def _home(self, h: np.ndarray) -> np.ndarray:
        return ((h * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Length of each word, 0 where it is not held."""
        h = hash_strings(words)
        at, out = self._home(h), np.zeros(len(h), np.int64)
        open_ = np.arange(len(h))
        while len(open_):
            found = self.keys[at[open_]]
            hit = found == h[open_]
            out[open_[hit]] = self.lengths[at[open_[hit]]]
            open_ = open_[~hit & (found != 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return out


@cache
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _rules(path: str):
    """The splitting pattern and the special strings, from the tokenizer's own file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    special = [t["content"] for t in spec["added_tokens"]]
    return regex.compile(split["pattern"]["Regex"]).findall, regex.compile("|".join(map(regex.escape, special))), spec


def frequent_lengths(path: str) -> LengthTable:
    """Lengths of the vocabulary's whole words, as the library itself encodes them."""
    split, _, spec = _rules(path)
    end = spec["model"]["end_of_word_suffix"]
    decode = {c: b for b, c in _byte_letters().items()}
    words = []
    for entry in spec["model"]["vocab"]:
        if entry.endswith(end) and len(entry) > len(end) and all(c in decode for c in entry[: -len(end)]):
            try:
                word = bytes(decode[c] for c in entry[: -len(end)]).decode()
            except UnicodeDecodeError:
                continue
            if normalised(word) == word and split(word) == [word]:
                words.append(word)
    counts = [len(e.ids) for e in _library(path).encode_batch(words, add_special_tokens=False)]
    return LengthTable([w.encode() for w in words], counts)


def _byte_letters() -> dict[int, str]:
    """The usual printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in plain}
    letters.update({b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letters)})
    return letters


LETTERS = {b: c for b, c in _byte_letters().items() if chr(b) != c}


#: Lower-case forms newer than some Python versions' tables, and the sigma, which never takes its final form.
LOWER = {0x03A3: 0x03C3, 0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
SPECIAL_LOWER = regex.compile("[" + "".join(map(chr, LOWER)) + "]").search


def normalised(text: str) -> str:
    """NFC and lower case, letter by letter."""
    text = unicodedata.normalize("NFC", text)
    return (text.translate(LOWER) if SPECIAL_LOWER(text) else text).lower()


class Counter:
    """Counts one text after another; keeps the lengths of pre-tokens it has met."""

    def __init__(self, path: str, table: LengthTable):
        self.library, self.table = _library(path), table
        self.split, self.special, _ = _rules(path)
        self.known: dict[str, int] = {}

    def resolve(self, fresh: list[str]) -> None:
        lengths = self.table.look_up([w.encode() for w in fresh]).tolist()
        rest = [w for w, n in zip(fresh, lengths) if not n]
        self.known.update(zip(fresh, lengths))
        if rest:
            tokenize = self.library.model.tokenize  # a pre-token's bytes are the model's letters
            self.known.update((w, len(tokenize(w.encode().decode("latin-1").translate(LETTERS)))) for w in rest)

    def count(self, text: str) -> int:
        total, parts = 0, [text]
        if UNASSIGNED(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        if self.special.search(text):
            parts = self.special.split(text)
            total = len(parts) - 1
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        for part in parts:
            pieces = self.split(normalised(part))
            if fresh := set(pieces).difference(self.known):
                self.resolve(list(fresh))
            total += sum(map(self.known.__getitem__, pieces))
        return total


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    counters: dict[int, Counter] = {}

    def run(cols):
        if 0 not in counters:
            counters[0] = Counter(path, shared.value)
        return {"doc_id": cols["doc_id"], "text_bytes": [len(t.encode()) if t else 0 for t in cols["text"]], "n_tokens": [counters[0].count(t or "") for t in cols["text"]]}

    rows = ids_and_text(docs, id_col, text_col)
    counted = map_columns(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_bytes bigint, n_tokens bigint")
    return counted.select("doc_id", F.col("text_bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
