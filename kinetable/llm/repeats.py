"""Suffix-array dedup: removes the bytes of every long string that occurs more than once.

A window (``length`` bytes) is repeated if it starts anywhere else too, in any document.

1. Every window has an anchor, its leftmost smallest k-gram hash; neighbouring windows with the same
   anchor form a *context*.  Equal windows have equal anchors at equal distances, so only contexts of
   the same anchor hash can hold equal windows.  Anchors that occur once are done.
2. Contexts of the same content are one *class*, counted within each text first.  A class with two contexts is repeated throughout.
   Other classes are compared with all classes of their anchor.
3. Compared classes go to shards by anchor.  A shard cuts each context into symbols of eight bytes,
   aligned to its anchor, and takes the Burrows-Wheeler transform of them all.  Breadth-first backward
   extension of its intervals yields the common prefixes by increasing value and stops at the number
   of whole symbols that every window holds: suffixes not told apart by then agree on that many.
   Windows of such a suffix class are equal if the eight bytes left over at their two ends are, too.
4. An anchor with more than ``dense`` classes isn't gathered: each of its windows becomes a row with
   the window's hash, and a grouped count decides.

Passages of a number of words are windows of the same kind once every word is a code of eight letters.

Texts travel as rows of their own; fixed-size rows do the counting.  Null text is empty; texts shorter
than a window lose nothing; repeated rows lose every byte that a window covers; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import BYTE_VALUES, encoded, map_columns, mixed, prefix_sums, range_hashes, sliced, with_new_text, written

c = F.col
LENGTH, GRAM, SYMBOL = 400, 128, 8
#: Bytes of white space, and all other characters of it.
WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: A word's code: one symbol of letters, six bits of its hash each.
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: An anchor with more classes is settled by counting window hashes.
DENSE = 4096
#: Bytes of compared contexts in a shard, on average; an anchor of ``DENSE`` classes adds at most as much again.
SHARD_BYTES = 2 << 20
CLASS = ["h", "off", "run", "ctx"]


# --------------------------------------------------------------------------- contexts


def contexts(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Text number, first window, number of further windows, anchor's distance, anchor hash and content hash of each context."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.zeros(0, np.int64)
    if len(buf) < length:
        return empty, empty, empty, empty, empty, empty
    sums = prefix_sums(BYTE_VALUES[buf])
    grams = np.arange(len(buf) - gram + 1)
    least = h = range_hashes(sums, grams, grams + gram)
    place = grams.astype(np.int32)
    width, span = 1, length - gram + 1
    while width < span:  # sliding minimum by doubling, leftmost on ties
        step = min(width, span - width)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        width += step
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.flatnonzero(owner[: len(place)] == owner[length - 1 :])
    if not len(start):
        return empty, empty, empty, empty, empty, empty
    anchor = place[start].astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(start) != 1)]))
    first, last = start[cut], start[np.append(cut[1:] - 1, len(start) - 1)]
    anchor = anchor[cut]
    own = owner[first]
    return own, first - begin[own], last - first, anchor - first, h[anchor].view(np.int64), range_hashes(sums, first, last + length).view(np.int64)


def own_repeats(own, at, span, off, h, ctx):
    """Contexts of one class within one text, as in periodic text, count together.

    Returns which contexts to keep (the first of each), how many each stands for, and, as their windows
    are repeated whatever else there is, the joined ranges of those with more than one: text, first, last.
    """
    order = np.lexsort((at, span, off, ctx, h, own))
    same = np.ones(len(order) - 1, bool) if len(order) else np.zeros(0, bool)
    for k in (own, h, ctx, off, span):
        same &= np.diff(k[order]) == 0
    head = np.concatenate([[True], ~same]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(head) - 1
    times = np.bincount(group) if len(order) else np.zeros(0, np.int64)
    many = np.zeros(len(order), bool)
    many[order] = times[group] > 1
    kept = order[head]
    rows = np.flatnonzero(many)
    new = np.concatenate([[True], (own[rows[1:]] != own[rows[:-1]]) | (at[rows[1:]] != at[rows[:-1]] + span[rows[:-1]] + 1)]) if len(rows) else np.zeros(0, bool)
    begin, end = rows[new], rows[np.append(np.flatnonzero(new)[1:] - 1, len(rows) - 1)] if len(rows) else rows
    return kept, times, (own[begin], at[begin], at[end] + span[end])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(c(text_col), F.lit(""))
    return docs.select(c(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))


def _context_rows(keyed: DataFrame, length: int, gram: int, coded: bool = False) -> DataFrame:
    """A row a text and class, with its number ``m`` in the text; rows without a class are ranges that are repeated anyway."""

    def run(cols):
        own, at, span, off, h, ctx = contexts(encoded([word_codes(t) for t in cols["text"]] if coded else cols["text"]), length, gram)
        if not len(own):
            return None
        kept, times, (text, first, last) = own_repeats(own, at, span, off, h, ctx)
        of = np.concatenate([own[kept], text])
        pick = lambda name: np.array(cols[name], np.int64)[of]
        both = lambda a, b: pa.concat_arrays([pa.array(a), b])
        none = pa.nulls(len(text), pa.int64())
        return {
            "doc_id": pa.array(cols["doc_id"]).take(pa.array(of)), "t1": pick("t1"), "t2": pick("t2"), "at": np.concatenate([at[kept], first]),
            "off": both(off[kept], none), "run": np.concatenate([span[kept], last - first]), "h": both(h[kept], none), "ctx": both(ctx[kept], none), "m": both(times, none),
        }

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return map_columns(keyed, run, f"doc_id {kind}, t1 bigint, t2 bigint, at int, off int, run int, h bigint, ctx bigint, m bigint")


# ---------------------------------------------------------------- Burrows-Wheeler transform


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; separators are distinct, so no two suffixes are equal."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(np.diff(symbols[order]) != 0)])
    step = 1
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        step *= 2
    return order


def short_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with its predecessor, up to ``most``: the value ``most`` means that or more.

    Breadth first: an interval holds the suffixes that start with one string.  Extending it to the left
    by a symbol maps its rows to a run of rows (by the last-to-first mapping of the transform); the
    row behind that run differs at the string's length, unless a shorter string has told it apart.
    """
    n = len(symbols)
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    step_left = row_of[order - 1]  # last-to-first mapping; the first symbol follows the last one
    first = symbols[order]
    lcp = np.full(n + 1, most, np.int32)
    lcp[0] = lcp[n] = -1
    lo, hi = np.array([0]), np.array([n])
    mark = np.zeros(n, np.int64)
    for value in range(most):
        size = hi - lo
        inside = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(inside)) - np.repeat(np.cumsum(size) - size, size) + lo[inside]
        to = step_left[rows]
        mark[to] = inside + 1
        hit = np.flatnonzero(mark)
        of = mark[hit]
        new = np.concatenate([[True], (of[1:] != of[:-1]) | (first[hit[1:]] != first[hit[:-1]])])
        begin = hit[new]
        end = hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)] + 1
        mark[to] = 0
        fresh = lcp[end] == most
        lo, hi = begin[fresh], end[fresh]
        lcp[hi] = value
        if not len(lo):
            break
    return lcp[:n]


def repeated_windows(data: list[bytes], offs: np.ndarray, runs: np.ndarray, copies: np.ndarray, length: int = LENGTH, symbol: int = SYMBOL) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more in all contexts, counted with ``copies``."""
    sizes = runs + length
    begin = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"".join(data) + bytes(symbol), np.uint8)
    lead = offs % symbol  # symbols start where (position - anchor) is a multiple of their size
    count = (sizes - lead) // symbol
    whole = (length - symbol + 1) // symbol  # every window holds so many symbols in a row
    first = np.cumsum(count + 1) - (count + 1)
    at = np.repeat(begin + lead - first * symbol, count + 1) + np.arange((count + 1).sum()) * symbol
    words = np.zeros(len(at), np.uint64)
    for k in range(symbol):
        words |= buf[np.minimum(at + k, len(buf) - 1)].astype(np.uint64) << np.uint64(8 * k)
    ends = first + count  # a separator of its own behind each context
    inner = np.ones(len(at), bool)
    inner[ends] = False
    symbols = np.empty(len(at), np.int64)
    symbols[ends] = np.arange(len(ends))
    symbols[inner] = np.unique(words[inner], return_inverse=True)[1] + len(ends)
    order = suffix_order(symbols)
    told = short_prefixes(symbols, order, whole) < whole
    klass = np.empty(len(at), np.int64)
    klass[order] = np.cumsum(told)

    windows = runs + 1
    ctx = np.repeat(np.arange(len(runs)), windows)
    start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    phase = (start - lead[ctx]) % symbol  # bytes of the symbol before that the window leaves out
    skip = (symbol - phase) % symbol
    head = first[ctx] + (start + skip - lead[ctx]) // symbol
    left = begin[ctx] + start
    right = left + skip + whole * symbol
    rest = np.zeros(len(ctx), np.uint64)
    tail = length - whole * symbol  # bytes left over at both ends together
    for k in range(tail):
        here = np.where(k < skip, left + k, right + k - skip)
        rest = rest * np.uint64(257) + buf[np.minimum(here, len(buf) - 1)].astype(np.uint64) + np.uint64(1)
    key = np.stack([klass[head].astype(np.uint64) * np.uint64(symbol) + phase.astype(np.uint64), rest])
    by = np.lexsort(key)
    new = np.concatenate([[True], (np.diff(key[:, by], axis=1) != 0).any(axis=0)])
    total = np.bincount(np.cumsum(new) - 1, weights=copies[ctx[by]])
    many = np.empty(len(ctx), bool)
    many[by] = (total >= 2)[np.cumsum(new) - 1]
    return np.split(many, np.cumsum(windows)[:-1])


def ranges(flags: np.ndarray) -> list[list[int]]:
    """Runs of true flags as ``[first, last]``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return [[int(a), int(b) - 1] for a, b in zip(edge[::2], edge[1::2])]


# ------------------------------------------------------------------------------ jobs


def spans(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, dense: int = DENSE, shard_bytes: int = SHARD_BYTES, coded: bool = False) -> DataFrame:
    """``t1, t2, spans``: of each text (by its two hashes) the ranges of first bytes of repeated windows.

    ``coded``: windows, ranges and lengths are those of the texts' word codes.
    """
    rows = written(_context_rows(keyed, length, gram, coded), "contexts")
    classed = rows.filter("m IS NOT NULL")
    groups = classed.groupBy(*CLASS).agg(F.sum("m").alias("n"), F.min(F.struct("t1", "t2", "doc_id", "at")).alias("one"))
    groups = written(groups, "classes")
    anchors = groups.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).filter("k > 1 AND least = 1")
    compared = written(groups.join(anchors.select("h", "k"), "h").select(*CLASS, "n", "one.*", "k"), "compared")
    stats = compared.agg(F.sum(F.col("run") + length).alias("size"), F.max("k").alias("k")).first()
    settled = [groups.filter("n > 1").select(*CLASS, F.array(F.struct(F.lit(0).alias("lo"), c("run").alias("hi"))).alias("ranges"))]
    if stats["size"]:
        text = _with_text(_coded(keyed) if coded else keyed, compared, length)
        if stats["k"] > dense:
            text = written(text, "compared-texts")
            settled.append(_by_counts(text.filter(c("k") > dense), length))
            text = text.filter(c("k") <= dense)
        settled.append(_by_transform(text, max(1, int(stats["size"] // shard_bytes) + 1), length))
    verdicts = settled[0]
    for more in settled[1:]:
        verdicts = verdicts.unionByName(more)
    sure = rows.filter("m IS NULL").select("t1", "t2", "at", F.array(F.struct(F.lit(0).alias("lo"), c("run").alias("hi"))).alias("ranges"))
    found = classed.filter("m = 1").join(written(verdicts, "verdicts"), CLASS).select("t1", "t2", "at", "ranges").unionByName(sure).distinct()
    shifted = F.transform("ranges", lambda r: F.struct((c("at") + r["lo"]).alias("lo"), (c("at") + r["hi"]).alias("hi")))
    return found.select("t1", "t2", shifted.alias("own")).groupBy("t1", "t2").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("spans"))


def _with_text(keyed: DataFrame, compared: DataFrame, length: int) -> DataFrame:
    """The bytes of one context of each compared class, cut from the text that holds it."""
    entry = F.struct(*CLASS, "n", "k", "at")
    wanted = compared.groupBy("t1", "t2", "doc_id").agg(F.collect_list(entry).alias("wanted"))
    wanted = wanted.select(c("t1").alias("w1"), c("t2").alias("w2"), c("doc_id").alias("w3"), "wanted")
    met = keyed.join(wanted, (c("t1") == c("w1")) & (c("t2") == c("w2")) & c("doc_id").eqNullSafe(c("w3")))
    cut = met.select(c("text").cast("binary").alias("data"), F.explode("wanted").alias("w"))
    return cut.select("w.*", F.substring("data", c("w.at") + 1, c("w.run") + length).alias("data"))


_VERDICT = "h bigint, off int, run int, ctx bigint, ranges array<struct<lo:int,hi:int>>"


def _by_transform(text: DataFrame, shards: int, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        seen, keep = set(), []
        keys = list(zip(*[table.column(k).to_pylist() for k in CLASS]))
        for i, k in enumerate(keys):  # repeated rows of a document give a context twice
            if k not in seen:
                seen.add(k)
                keep.append(i)
        table = table.take(keep)
        cols = {k: table.column(k).to_numpy() for k in (*CLASS, "n")}
        flags = repeated_windows(table.column("data").to_pylist(), cols["off"].astype(np.int64), cols["run"].astype(np.int64), cols["n"], length)
        pick = np.array([i for i, f in enumerate(flags) if cols["n"][i] == 1 and f.any()], np.int64)
        made = {k: cols[k][pick] for k in CLASS} | {"ranges": [[{"lo": a, "hi": b} for a, b in ranges(flags[i])] for i in pick.tolist()]}
        parts = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        kinds = {"h": pa.int64(), "off": pa.int32(), "run": pa.int32(), "ctx": pa.int64(), "ranges": parts}
        return pa.table({k: pa.array(made[k], t) for k, t in kinds.items()})

    shard = F.pmod(F.xxhash64("h"), F.lit(shards))
    return text.select(*CLASS, "n", "data", shard.alias("shard")).groupBy("shard").applyInArrow(run, _VERDICT)


def _by_counts(text: DataFrame, length: int) -> DataFrame:
    """Windows of crowded anchors, a row each, counted by two hashes of their content."""

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                data, run_ = part.column("data").to_pylist(), np.array(part.column("run").to_pylist(), np.int64)
                buf = np.frombuffer(b"".join(data), np.uint8)
                sizes = run_ + length
                ctx = np.repeat(np.arange(len(run_)), run_ + 1)
                place = np.arange(len(ctx)) - np.repeat(np.cumsum(run_ + 1) - run_ - 1, run_ + 1)
                start = (np.cumsum(sizes) - sizes)[ctx] + place
                one = range_hashes(prefix_sums(BYTE_VALUES[buf]), start, start + length)
                two = range_hashes(prefix_sums(mixed(BYTE_VALUES)[buf]), start, start + length)
                cols = {k: part.column(k).take(pa.array(ctx)) for k in (*CLASS, "n")}
                yield pa.RecordBatch.from_pydict(cols | {"place": pa.array(place, pa.int32()), "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64))})

    single = text.dropDuplicates(CLASS).select(*CLASS, "n", "data")
    windows = written(single.mapInArrow(run, "h bigint, off int, run int, ctx bigint, n bigint, place int, one bigint, two bigint"), "windows")
    many = windows.groupBy("one", "two").agg(F.sum("n").alias("all")).filter(c("all") > 1).drop("all")
    found = windows.filter("n = 1").join(many, ["one", "two"])
    return found.groupBy(*CLASS).agg(F.array_sort(F.collect_list(F.struct(c("place").alias("lo"), c("place").alias("hi")))).alias("ranges"))


def cover(starts: list, length: int) -> list[list[int]]:
    """Maximal byte ranges ``[first, past the last]`` of windows whose first bytes are given as ranges."""
    out: list[list[int]] = []
    for lo, hi in starts:
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return out


def kept_bytes(data: bytes, removed: list[list[int]]) -> bytes:
    parts, at = [], 0
    for a, b in removed:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text`` (null is empty) and ``spans`` (first bytes of repeated windows; null if none) of every row."""
    keyed = _keyed(docs, id_col, text_col)
    found = written(spans(keyed, **options), "spans").select(c("t1").alias("w1"), c("t2").alias("w2"), "spans")
    return keyed.join(found, (c("t1") == c("w1")) & (c("t2") == c("w2")), "left").select("doc_id", "text", "spans")


def digests(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""

    def run(cols):
        out: dict[str, list] = {"doc_id": cols["doc_id"], "size": [], "gone": [], "parts": [], "digest": []}
        for data, starts in zip(encoded(cols["text"]), cols["spans"]):
            gone = cover([(s["lo"], s["hi"]) for s in starts or []], length)
            out["size"].append(len(data))
            out["gone"].append(sum(b - a for a, b in gone))
            out["parts"].append(len(gone))
            out["digest"].append(hashlib.sha256(kept_bytes(data, gone)).hexdigest())
        return out

    rows = located(docs, length=length, **options)
    kind = rows.schema["doc_id"].dataType.simpleString()
    done = map_columns(rows, run, f"doc_id {kind}, size bigint, gone bigint, parts bigint, digest string")
    return done.select("doc_id", c("size").alias("n_bytes"), c("gone").alias("n_removed"), c("parts").alias("n_spans"), c("digest").alias("kept_sha256"))


# ------------------------------------------------------------------------------ words


def word_bounds(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, and of each of its words the first byte and the one behind it."""
    data = WIDE_SPACE.sub(lambda m: " " * len(m[0].encode()), text or "").encode()
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[buf], [True]]).astype(np.int8)))
    return buf, edge[::2], edge[1::2]


def word_codes(text: str | None) -> str:
    """The words of a text as codes of ``SYMBOL`` letters each, without the space between them."""
    buf, first, end = word_bounds(text)
    h = range_hashes(prefix_sums(BYTE_VALUES[buf]), first, end)
    return LETTERS[(h[:, None] >> (np.arange(SYMBOL, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)].tobytes().decode()


def _coded(keyed: DataFrame) -> DataFrame:
    """``keyed`` with word codes for texts, and the hashes of the texts themselves."""

    def run(cols):
        return cols | {"text": [word_codes(t) for t in cols["text"]]}

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return map_columns(keyed, run, f"doc_id {kind}, text string, t1 bigint, t2 bigint")


def word_cover(text: str, starts: list, words: int) -> list[list[int]]:
    """Maximal byte ranges of the passages whose windows of codes start in the given ranges."""
    _, first, end = word_bounds(text)
    whole = [(-(-lo // SYMBOL), hi // SYMBOL) for lo, hi in starts]  # other windows begin within a word
    return joined([[int(first[lo]), int(end[hi + words - 1])] for lo, hi in whole if lo <= hi])


def joined(parts: list[list[int]]) -> list[list[int]]:
    """Maximal ranges of the bytes in any of ``parts``."""
    out: list[list[int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def cleaned(docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: int | None = None, **options) -> DataFrame:
    """``docs`` without the repeated bytes; all rows and columns stay, null texts stay null.

    With ``words``, passages of so many words that occur more than once go too, however few bytes they
    have; white space between the words may differ.
    """
    own = docs.withColumns({"_kt_t1": F.xxhash64(F.coalesce(c(text_col), F.lit(""))), "_kt_t2": F.xxhash64(F.lit(1), F.coalesce(c(text_col), F.lit("")))})
    keyed = _keyed(docs, "doc_id", text_col)
    found = spans(keyed, length=length, **options).withColumn("_kt_words", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    if words:
        passages = spans(keyed, length=words * SYMBOL, coded=True).select("t1", "t2", c("spans").alias("_kt_words"))
        found = written(found.drop("_kt_words"), "byte-spans").join(written(passages, "word-spans"), ["t1", "t2"], "full")
    found = written(found, "spans").select(c("t1").alias("_kt_w1"), c("t2").alias("_kt_w2"), c("spans").alias("_kt_spans"), "_kt_words")
    met = own.join(found, (c("_kt_t1") == c("_kt_w1")) & (c("_kt_t2") == c("_kt_w2")), "left")
    pairs = lambda g: [] if g is None else [(s["lo"], s["hi"]) for s in g]

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, passages: pd.Series) -> pd.Series:
        out = []
        for t, g, w in zip(text, starts, passages):
            gone = joined(cover(pairs(g), length) + (word_cover(t, pairs(w), words) if w is not None else []))
            out.append(text_kept(t.encode(), gone) if gone else None)
        return pd.Series(out, dtype=object)

    return with_new_text(met, F.coalesce(cut(c(text_col), c("_kt_spans"), c("_kt_words")), c(text_col)), text_col).select(*[c(f"`{n}`") for n in docs.columns])


def text_kept(data: bytes, removed: list[list[int]]) -> str:
    """The rest as text; a character of which a part is removed goes whole."""
    return kept_bytes(data, removed).decode("utf-8", "ignore")


def reference(texts: list[bytes], length: int = LENGTH) -> list[list[list[int]]]:
    """Brute force for tests: removed ranges of each text."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    return [cover([(i, i) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1], length) for t in texts]
