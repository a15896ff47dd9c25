"""SimHash near-duplicates by multi-index hashing.

A fingerprint bit is 1 if it is set in over half the XXH64 hashes of a text's word shingles.
Fingerprints link at few differing bits; a component is what links reach.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import ids_and_text, map_columns, written
from kinetable.llm.components import components

c = F.col

SEED, SHINGLE, RADIUS = 42, 4, 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the lower-cased (A-Z) text's word shingles; no words give zero."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    parts = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())]
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


# ------------------------------------------------------------------------------ linking

#: Bit ranges of a fingerprint and the ball enumerated in each.  Two fingerprints within four
#: bits can't exceed every radius: that takes (1 + 1) + (1 + 1) + (0 + 1) = 5 differing bits.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
BITS = 64
#: Buckets with more fingerprints aren't paired: balls of half the radius around each of them meet instead.
DENSE = 1024


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (as a signed long) and a text hash ``th`` of every row; null text counts as empty."""

    def run(cols):
        found = np.array([fingerprint(t) for t in cols["text"]], np.uint64)
        return {"doc_id": cols["doc_id"], "fp": found.view(np.int64), "th": cols["th"]}

    rows = ids_and_text(docs, id_col, text_col).withColumn("th", _text_hash())
    return map_columns(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint, th bigint")


def _segment(k: int, segments: tuple = SEGMENTS) -> Column:
    start, width, _ = segments[k]
    return F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))


def _masks(width: int, radius: int) -> Column:
    """All words of ``width`` bits with at most ``radius`` ones."""
    words = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return F.array(*[F.lit(w).cast("long") for w in words])


def _stored(fps: DataFrame, segments: tuple = SEGMENTS) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(k).alias("segment"), _segment(k, segments).alias("word")) for k in range(len(segments))])
    return fps.select("fp", F.explode(keys).alias("key")).select("fp", "key.*")


def _probes(fps: DataFrame, segments: tuple = SEGMENTS) -> DataFrame:
    """Every stored key within the segment's radius of a fingerprint."""
    parts = []
    for k, (_, width, radius) in enumerate(segments):
        mask = fps.select("fp", _segment(k, segments).alias("own"), F.explode(_masks(width, radius)).alias("mask"))
        parts.append(mask.select("fp", F.lit(k).alias("segment"), c("own").bitwiseXOR(c("mask")).alias("word")))
    return reduce(DataFrame.unionByName, parts)


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """Edges ``u, v`` whose components are those of all pairs within ``radius`` bits.

    ``fps``: distinct ``fp``.  Buckets of at most ``dense`` fingerprints give their verified pairs.
    """
    if radius > 4:
        raise ValueError("the segments guarantee at most four differing bits")
    stored = _stored(fps)
    crowded = written(stored.groupBy("segment", "word").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > dense).drop("n"), "crowded")
    probes = _probes(fps)
    some = not crowded.isEmpty()
    sparse = stored.join(crowded, ["segment", "word"], "left_anti") if some else stored
    near = F.bit_count(c("fp").bitwiseXOR(c("other"))) <= radius
    table_side = sparse.select(c("segment").alias("s2"), c("word").alias("w2"), c("fp").alias("other"))
    met = probes.join(table_side, (c("segment") == c("s2")) & (c("word") == c("w2")) & (c("fp") != c("other")) & near)
    pairs = met.select(F.greatest("fp", "other").alias("u"), F.least("fp", "other").alias("v"))
    if some:
        members = probes.join(crowded, ["segment", "word"], "left_semi").select("fp").distinct()
        pairs = pairs.unionByName(_meeting(members, radius))
    return pairs.distinct()


def _meeting(members: DataFrame, radius: int) -> DataFrame:
    """Stars around every word within half the radius of two members or more.

    Members that share such a word are within ``radius``; members within ``radius`` share one.
    A member costs a fixed number of rows, however many others are near.
    """
    if radius % 2:
        raise ValueError("the balls meet for even radii")
    ball = members.select("fp", F.explode(_masks(BITS // 2, radius // 2)).alias("low"))
    ball = ball.select("fp", "low", F.explode(_masks(BITS // 2, radius // 2)).alias("high"))
    ball = ball.filter(F.bit_count("low") + F.bit_count("high") <= radius // 2)
    met = ball.select("fp", c("fp").bitwiseXOR(c("low")).bitwiseXOR(F.shiftleft("high", BITS // 2)).alias("word"))
    hubs = met.groupBy("word").agg(F.min("fp").alias("v"), F.max("fp").alias("_kt_most")).filter("v < _kt_most").drop("_kt_most")
    return met.join(hubs, "word").filter("fp <> v").select(c("fp").alias("u"), "v")


def _text_hash(text_col: str = "text") -> Column:
    return F.xxhash64(F.coalesce(c(text_col), F.lit("")))


def _placed(docs: DataFrame, id_col: str, text_col: str, dense: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, fp, th`` (a text hash), and of each fingerprint its component's ``root`` and ``component_id``."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), dense=dense))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return rows, written(placed.join(names, "root").select(c("fp").alias("_kt_fp"), "root", "component_id"), "classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row, with the smallest id that links reach.

    Equal fingerprints are one node.  Null ids are kept as rows; they name a component only if it
    has no other id (then null).  An empty table gives no rows.
    """
    rows, named = _placed(docs, id_col, text_col, dense)
    return rows.join(named, c("fp") == c("_kt_fp")).select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one whose id names it, repeated rows of it once.

    Rows of one id with different texts are documents of their own, in groups of their own unless they are alike.
    Documents without an id stay, since nothing tells which of them to keep.
    """
    rows, named = _placed(docs, "doc_id", "text", DENSE)
    own = rows.join(named, (c("fp") == c("_kt_fp")) & (c("doc_id") == c("component_id")))
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "th")).alias("_r")).select(c("_r.doc_id").alias("_kt_id"), c("_r.th").alias("_kt_th"))
    kept = docs.withColumn("_kt_text", _text_hash()).join(first, (c("doc_id") == c("_kt_id")) & (c("_kt_text") == c("_kt_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_kt_text"]).drop("_kt_text").unionByName(docs.filter("doc_id IS NULL"))
