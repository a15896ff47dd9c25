"""Benchmark decontamination with an FM-index per training shard.

Texts become words (runs of digits, letters lower-cased in ASCII, and all other non-ASCII bytes).
A shard is a bounded group of whole documents of one Arrow batch.  Its FM-index covers every stretch
of words that the test phrases' vocabulary could fill: a word outside that vocabulary, and a stretch
shorter than the shortest phrase it could hold, can't be part of any occurrence.  Test phrases are
searched backward through wavelet-tree ranks; occurrences are located by walking to sampled suffix
positions, compared with the document's own bytes, and merged into spans.

The test phrases are a table, dealt to blocks of bounded size by a hash; each block is a pass over the
documents, so nothing of unbounded size is sent to the tasks or held by the driver.  Null texts have no words; an item without words has
no windows; rows, repeated ones too, give one result row each.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import BYTE_VALUES, encoded, grouped, ids_and_text, map_columns, prefix_sums, range_hashes, with_new_text, written

WINDOW = 10
#: Windows that one pass searches for; more are searched in further passes.
BLOCK_WINDOWS = 200_000
SAMPLING = 16
#: Text of a shard, about.
SHARD_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def word_ranges(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, starts and ends of their words, and the text of each word."""
    buf = _LOWER[np.frombuffer(b"".join([t + b"\n" for t in texts]), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _WORD[buf], [False]])))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return buf, starts, ends, np.searchsorted(text_ends, starts, side="right")


class WaveletTree:
    """Ranks of symbols in a sequence: one bit level for each bit of a symbol, zeros before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for k in range(bits - 1, -1, -1):
            bit = (symbols >> k) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((k, ones, len(bit) - int(ones[-1])))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbol: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position; ``first``: its start in the last level."""
        for k, ones, zeros in self.levels:
            up = ((symbol >> k) & 1) == 1
            one = ones[at]
            at = np.where(up, zeros + one, at - one)
        return at - first

    def first_places(self, symbol: np.ndarray) -> np.ndarray:
        return self.ranks(symbol, np.zeros(len(symbol), np.int64), np.int64(0))

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at each position, and its place in the last level."""
        symbol = np.zeros(len(at), np.int64)
        for k, ones, zeros in self.levels:
            one = ones[at]
            bit = ones[at + 1] - one
            symbol |= bit.astype(np.int64) << k
            at = np.where(bit == 1, zeros + one, at - one)
        return symbol, at


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol has to be the only smallest one."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Backward search and location in a sequence of symbols >= 2 (1 separates, 0 ends)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order = suffix_array(text)
        bits = max(1, int(alphabet - 1).bit_length())
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.first = self.tree.first_places(np.arange(alphabet))
        self.marked = order % SAMPLING == 0
        self.sample_no = np.concatenate([[0], np.cumsum(self.marked)])
        self.samples = order[self.marked]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix interval of each pattern (rows, padded at the right); an empty one if it doesn't occur."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in range(patterns.shape[1]):
            at = np.flatnonzero((lengths > k) & (lo < hi))
            if not len(at):
                break
            s = patterns[at, lengths[at] - 1 - k]
            base, first = self.before[s], self.first[s]
            lo[at] = base + self.tree.ranks(s, lo[at], first)
            hi[at] = base + self.tree.ranks(s, hi[at], first)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by backward steps to the next sampled one."""
        rows, out, steps = rows.copy(), np.full(len(rows), -1, np.int64), 0
        open_ = np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            done = self.marked[at]
            out[open_[done]] = self.samples[self.sample_no[at[done]]] + steps
            open_ = open_[~done]
            symbol, place = self.tree.access(rows[open_])
            rows[open_] = self.before[symbol] + place - self.first[symbol]
            steps += 1
        return out


class Phrases:
    """A block of test phrases: windows of words over a vocabulary of word hashes."""

    def __init__(self, windows: list[tuple[bytes, ...]], items: list[list]):
        self.windows, self.items = windows, items
        words = sorted({w for ws in windows for w in ws})
        hashes = _hashes(words)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]
        number = {words[w]: i + 2 for i, w in enumerate(order.tolist())}
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.patterns = np.zeros((len(windows), int(self.lengths.max(initial=1))), np.int64)
        for i, ws in enumerate(windows):
            self.patterns[i, : len(ws)] = [number[w] for w in ws]
        self.joined = [b" ".join(ws) for ws in windows]
        # a word can be hit only beside a neighbour that some phrase has there too
        size = len(words) + 2
        self.pairs = np.unique(np.concatenate([[0], *[p[: n - 1] * size + p[1:n] for p, n in zip(self.patterns, self.lengths) if n > 1]]))
        self.single = np.zeros(size, bool)
        self.single[self.patterns[self.lengths == 1, 0]] = True
        self.size = size


def _hashes(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return range_hashes(prefix_sums(BYTE_VALUES[buf]), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def _member(values: np.ndarray, sorted_set: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_set, values), max(len(sorted_set) - 1, 0))
    return at, (sorted_set[at] == values if len(sorted_set) else np.zeros(len(values), bool))


def occurrences(texts: list[bytes], phrases: Phrases):
    """Word counts of the texts, and each occurrence's text, first word in it, and window."""
    buf, starts, ends, owner = word_ranges(texts)
    n_words = np.bincount(owner, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    none = np.zeros(0, np.int64)
    if not len(starts) or not len(phrases.windows):
        return n_words, none, none, none
    at, known = _member(range_hashes(prefix_sums(BYTE_VALUES[buf]), starts, ends), phrases.vocabulary)
    symbol = np.where(known, at + 2, 1)
    joint = symbol[:-1] * phrases.size + symbol[1:]
    linked = known[:-1] & known[1:] & (owner[:-1] == owner[1:])
    linked[linked] = _member(joint[linked], phrases.pairs)[1]
    after, before = np.append(linked, False), np.insert(linked, 0, False)
    part = known & (after | before | phrases.single[symbol])
    places = np.flatnonzero(part)
    if not len(places):
        return n_words, none, none, none
    # stretches of possible words; unlinked neighbours and other texts lie behind a separator
    cut = np.insert(~after[places[:-1]] | (np.diff(places) != 1), 0, True)
    stretch = np.cumsum(cut) - 1
    length = np.bincount(stretch)
    shortest = int(phrases.lengths.min())
    keep = (length >= shortest)[stretch]
    places, cut = places[keep], cut[keep]
    if not len(places):
        return n_words, none, none, none
    slot = np.arange(len(places)) + np.cumsum(cut)
    sequence, word_at = np.ones(slot[-1] + 2, np.int64), np.full(slot[-1] + 2, -1, np.int64)
    sequence[slot], word_at[slot] = symbol[places], places
    index = FMIndex(sequence, phrases.size)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    window = np.repeat(found, (hi - lo)[found])
    rows = np.concatenate([np.arange(a, b) for a, b in zip(lo[found], hi[found])]) if len(found) else none
    word = word_at[index.locate(rows)] if len(rows) else none
    same = [  # the bytes decide, not the hashes
        b" ".join([buf[s:e].tobytes() for s, e in zip(starts[w : w + n], ends[w : w + n])]) == phrases.joined[k]
        for w, k, n in zip(word.tolist(), window.tolist(), phrases.lengths[window].tolist())
    ]
    same = np.array(same, bool)
    word, window = word[same], window[same]
    return n_words, owner[word], word - first_word[owner[word]], window


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
    """Union of word ranges as ``[first, past the last]`` in order."""
    out: list[list[int]] = []
    for s, n in sorted(zip(starts.tolist(), lengths.tolist())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n)
        else:
            out.append([s, s + n])
    return out


def item_windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Windows of an item: ``size`` consecutive words, or all of fewer words; none without words."""
    buf, starts, ends, _ = word_ranges([(text or "").encode()])
    words = [buf[s:e].tobytes() for s, e in zip(starts, ends)]
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def windows_of(benchmark: DataFrame, size: int, most: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """``window, items`` of the distinct windows as a table, and the number of blocks they are dealt to."""

    def run(cols):
        out = [(i, w) for i, t in zip(cols["item"], cols["text"]) for w in dict.fromkeys(item_windows(t, size))]
        return {"item": pa.array([i for i, _ in out], pa.string()), "window": pa.array([w for _, w in out], pa.list_(pa.binary()))}

    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    each = map_columns(rows, run, "item string, window array<binary>")
    windows = written(each.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "test-windows")
    return windows, -(-windows.count() // most)


def block_of(windows: DataFrame, blocks: int, k: int) -> Phrases:
    """Block ``k`` of the windows; only this one is on the driver."""
    rows = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k).toLocalIterator()
    found = [(tuple(map(bytes, r["window"])), r["items"]) for r in rows]
    return Phrases([w for w, _ in found], [i for _, i in found])


def _search(rows: DataFrame, phrases: Phrases) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(phrases)

    def run(cols):
        p, texts = shared.value, encoded(cols["text"])
        n_words, owner, first, window = occurrences(texts, p)
        spans: list[list] = [[] for _ in texts]
        items: list[list] = [[] for _ in texts]
        for d in np.unique(owner).tolist():
            mine = owner == d
            spans[d] = merged(first[mine], p.lengths[window[mine]])
            items[d] = sorted({i for w in np.unique(window[mine]).tolist() for i in p.items[w] if i is not None})
        return {"doc_id": cols["doc_id"], "n_words": n_words, "spans": spans, "items": items}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows.select("doc_id", "text"), run, f"doc_id {kind}, n_words bigint, spans array<array<bigint>>, items array<string>", SHARD_BYTES)


def _hits(rows: DataFrame, windows: DataFrame, blocks: int) -> DataFrame:
    """``doc_id, spans, items`` of each document that a block of windows hits, a row a block, all on the same texts."""
    hits = None
    for k in range(blocks):
        phrases = block_of(windows, blocks, k)
        if phrases.windows or hits is None:
            found = written(_search(rows, phrases).filter("size(spans) > 0").select("doc_id", "spans", "items"), "hits")
            hits = found if hits is None else hits.unionByName(found)
    return hits


def united(spans: list[list[int]] | None) -> list[list[int]]:
    """Spans of several blocks merged."""
    return merged(np.array([x[0] for x in spans]), np.array([x[1] - x[0] for x in spans])) if spans else []


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, spans, items``: merged word spans of all occurrences, and the items they come from.

    With one block of test phrases (the usual case) nothing is shuffled.  With more, the blocks'
    results meet by document: rows that are equal in id and text are one document there, repeated after.
    """
    rows = ids_and_text(docs, id_col, text_col)
    windows, blocks = windows_of(benchmark, size, most)
    if blocks <= 1:
        return _search(rows, block_of(windows, 1, 0))
    keys = [F.xxhash64("text"), F.xxhash64(F.lit(1), "text")]
    keyed = rows.select(F.struct("doc_id", keys[0].alias("a"), keys[1].alias("b")).alias("doc_id"), "text")
    copies = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    hits = _hits(keyed, windows, blocks)
    merged_hits = hits.distinct().groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = _search(keyed, Phrases([], [])).select("doc_id", "n_words").distinct().join(copies, "doc_id").join(merged_hits, "doc_id", "left")
    union = F.udf(united, "array<array<bigint>>")
    out = joined.select("doc_id.doc_id", "n_words", union("s").alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_kt_copy"))
    return out.drop("_kt_copy")


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def removed(text: str | None, spans: list[list[int]]) -> str:
    """The text without the hit words and what stands between them."""
    data = (text or "").encode()
    _, starts, ends, _ = word_ranges([data])
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    out.append(data[at:])
    return b"".join(out).decode()


def cleaned(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = BLOCK_WINDOWS, text_col: str = "text") -> DataFrame:
    """``docs`` without the passages of the test set; all rows and columns stay, null texts stay null.

    What goes is the union of the occurrences of all windows; since a cut may bring the words of a
    further occurrence together, texts that were cut are searched again for all windows until none is left.
    With one block that happens in a single pass; with more, every round is a pass for each block.
    """
    windows, blocks = windows_of(benchmark, size, most)
    if blocks <= 1:
        shared = docs.sparkSession.sparkContext.broadcast(block_of(windows, 1, 0))
        return with_new_text(docs, _cutter(shared)(F.col(text_col)), text_col) if blocks else docs
    own = docs.withColumns({"_kt_a": F.xxhash64(text_col), "_kt_b": F.xxhash64(F.lit(1), text_col)})
    texts = own.filter(F.col(text_col).isNotNull()).select(F.struct(F.col("_kt_a").alias("a"), F.col("_kt_b").alias("b")).alias("doc_id"), F.col(text_col).alias("text"))
    now, rounds = written(texts.dropDuplicates(["doc_id"]), "texts"), []
    cut = F.udf(lambda t, s: removed(t, united(s)), "string")
    while True:
        hits = _hits(now, windows, blocks).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        now = written(now.join(hits, "doc_id").select("doc_id", cut("text", "spans").alias("text"), F.lit(len(rounds)).alias("round")), "cut-texts")
        if now.isEmpty():
            break
        rounds.append(now)
        now = now.drop("round")
    if not rounds:
        return docs
    last = reduce(DataFrame.unionByName, rounds).groupBy("doc_id").agg(F.max_by("text", "round").alias("_kt_text"))
    last = last.select(F.col("doc_id.a").alias("_kt_c"), F.col("doc_id.b").alias("_kt_d"), "_kt_text")
    met = own.join(last, (F.col("_kt_a") == F.col("_kt_c")) & (F.col("_kt_b") == F.col("_kt_d")) & F.col(text_col).isNotNull(), "left")
    return with_new_text(met, F.coalesce("_kt_text", text_col), text_col).select(*[F.col(f"`{n}`") for n in docs.columns])


def _cutter(shared):
    @F.pandas_udf("string")
    def cut(text: pd.Series) -> pd.Series:
        out = text.tolist()
        for todo in grouped(out):
            while todo:
                owner, first, window = occurrences([out[i].encode() for i in todo], shared.value)[1:]
                hit = np.unique(owner).tolist()
                for d in hit:
                    mine = owner == d
                    out[todo[d]] = removed(out[todo[d]], merged(first[mine], shared.value.lengths[window[mine]]))
                todo = [todo[d] for d in hit]
        return pd.Series(out, dtype=object)

    return cut


def reference_hits(text: str | None, benchmark: list[tuple], size: int = WINDOW) -> tuple[int, int, set]:
    """Brute force for tests: words, hit words and items of one text."""
    buf, starts, ends, _ = word_ranges([(text or "").encode()])
    words = [buf[s:e].tobytes() for s, e in zip(starts, ends)]
    hit, items = set(), set()
    for item, t in benchmark:
        for w in item_windows(t, size):
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    items.add(item)
    return len(words), len(hit), items


def digest(items: set) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
