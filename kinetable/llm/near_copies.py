"""Near copies beyond a fingerprint's few bits: SimHash by multi-index hashing, then exact shingles.

A text that shares 0.8 of its five-word shingles with another differs in up to eight bits of a SimHash over the set of
word pairs (measured: 0.99 of such pairs), while unrelated texts differ in seventeen or more.  Two fingerprints within
eight bits are within two in one of three segments, where balls of radius 1 around both meet; the pairs found are verified
by their whole distance, then by the exact Jaccard similarity of their shingles.  Documents that are linked so are one group, and its smallest id stays.

Crowded buckets are not paired.  Their members meet in their rarest shingles: in the order of the shingles' numbers of
texts, similar texts share one among their first ones, with enough of both behind it.  All that meet in a shingle are first
compared with one of them, the text with the fewest shingles before it, which in a large group of copies of one text is that
text or close to it; then members that this leaves in different groups are compared with each other.  So the groups are those of all
pairs, and a crowd of texts that are not alike costs what its rare shingles share, not its square.

Defined cases: a null text is empty; texts without words are copies of each other; rows with one id and different texts
are documents of their own; rows without an id stay and stand for nothing.  Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import map_columns, written
from kinetable.llm.components import components
from kinetable.llm.simhash import SEED, _probes, _text_hash

c = F.col

RADIUS, SHINGLE, SIMILAR, PAIR = 8, 5, 0.8, 2
#: Two fingerprints within eight bits can't exceed every radius: that takes 3 * (2 + 1) = 9 differing bits.
SEGMENTS = ((0, 22, 2), (22, 21, 2), (43, 21, 2))
#: Buckets with more fingerprints meet in their rarest shingles; it decides the way of work, not the groups.
DENSE = 16


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the lower-cased (A-Z) text's shingles; fewer words are one shingle, none are none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    parts = {joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())}
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the set of word pairs; no words give zero."""
    h = shingles(text, PAIR)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view(np.uint64)[0])


def _prints(docs: DataFrame) -> DataFrame:
    def run(cols):
        found = np.array([fingerprint(t) for t in cols["text"]], np.uint64)
        return {"doc_id": cols["doc_id"], "node": cols["node"], "fp": found.view(np.int64)}

    rows = docs.select("doc_id", "text", _text_hash().alias("node"))
    return map_columns(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, node bigint, fp bigint")


def _apart(a: str, b: str) -> Column:
    return F.bit_count(c(a).bitwiseXOR(c(b)))


def _met(fps: DataFrame) -> DataFrame:
    """``segment, word, fp`` for every word within a bit of a fingerprint's own in each segment.

    Two fingerprints within two bits in a segment share such a word, so a ball of radius 1 around each of both does what
    one of radius 2 around one does, with a tenth of the rows.
    """
    # a fingerprint is a few bytes and gives dozens of rows, so they are dealt out before these are made
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return _probes(dealt, tuple((start, width, radius // 2) for start, width, radius in SEGMENTS))


def candidates(nodes: DataFrame, dense: int = DENSE) -> tuple[DataFrame, DataFrame | None]:
    """Pairs ``u > v`` of nodes (``node, fp``) within ``RADIUS`` bits that meet in a bucket that is not crowded.

    A bucket is crowded if it holds over ``dense`` fingerprints more than eight times those that fall into any by chance,
    a fingerprint if it has over ``dense`` texts.  The nodes of both come along.
    """
    texts = written(nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "prints_of")
    many = texts.filter(c("n") > dense).select("fp")
    fps = texts.select("fp")
    stored = written(_met(fps), "met")
    usual = fps.count() * max((width + 1) / (1 << width) for _, width, _ in SEGMENTS)
    crowded = written(stored.groupBy("segment", "word").agg(F.count(F.lit(1)).alias("n")).filter(c("n") > dense + 8 * usual).drop("n"), "crowded")
    held = stored.join(many, "fp", "left_semi").select("segment", "word").unionByName(crowded).distinct()
    held = written(held, "held")
    some = not held.isEmpty()
    sparse = stored.join(held, ["segment", "word"], "left_anti") if some else stored
    other = sparse.select("segment", "word", c("fp").alias("other"))
    met = sparse.join(other, ["segment", "word"]).filter((c("fp") > c("other")) & (_apart("fp", "other") <= RADIUS))
    met = met.select("fp", "other").distinct().unionByName(texts.filter(c("n").between(2, dense)).select("fp", c("fp").alias("other")))
    left, right = nodes.select("fp", c("node").alias("a")), nodes.select(c("fp").alias("other"), c("node").alias("b"))
    pairs = met.join(left, "fp").join(right, "other").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    return pairs, nodes.join(stored.join(held, ["segment", "word"], "left_semi").select("fp").distinct(), "fp", "left_semi") if some else None


BUCKET = ("segment", "word")


def apart(held: DataFrame, groups: DataFrame, bucket: Sequence[str] = BUCKET, who: str = "fp", fits: Column | None = None) -> DataFrame:
    """Pairs ``u > v`` of members (``who``) of one bucket, within ``RADIUS`` bits, that lie in different groups (``who, root``).

    Of a bucket's largest group, only members that meet another group's are looked at, never its own pairs.  ``fits`` is a
    further condition on a member's columns and the other one's (``other_...``).
    """
    bucket = list(bucket)
    placed = written(held.join(groups, who), "grouped")
    sizes = placed.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("n"))
    several = sizes.groupBy(*bucket).agg(F.max(F.struct("n", "root")).alias("_m"), F.count(F.lit(1)).alias("groups")).filter("groups > 1")
    largest = written(several.select(*bucket, c("_m.root").alias("most")), "several")
    rest = placed.join(largest, bucket).filter("root <> most").drop("most")
    other = placed.join(largest, bucket, "left_semi").select(*bucket, *[c(n).alias(f"other_{n}") for n in placed.columns if n not in bucket])
    near = (c("root") != c("other_root")) & (_apart("fp", "other_fp") <= RADIUS)
    met = rest.join(other, bucket).filter(near if fits is None else near & fits)
    return met.select(F.greatest(who, f"other_{who}").alias("u"), F.least(who, f"other_{who}").alias("v")).distinct()


def rarest(sets: DataFrame) -> DataFrame:
    """``node, fp, s, size, left``: of each set ``node, fp, s``, the rarest elements, of which two similar sets share one.

    Sets with a Jaccard similarity of ``SIMILAR`` share so many elements that, in any order common to all, the first they
    share leaves ``left`` elements (itself included) of both that are no fewer than what they share.  Elements of one set
    only are left out.  Empty sets are similar, so they share an element made up for them.
    """
    sets = sets.withColumn("s", F.when(F.size("s") == 0, F.array(F.lit(0).cast("long"))).otherwise(c("s")))
    ones = written(sets.select("node", "fp", F.size("s").alias("size"), F.explode("s").alias("s")), "elements")
    common = written(ones.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "common")
    known = ones.join(common, "s").groupBy("node", "fp", "size").agg(F.sort_array(F.collect_list(F.struct("n", "s"))).alias("known"))
    # elements of no other set come first in the order, so what is left from a known one on is known too
    rows = known.select("node", "fp", "size", F.size("known").alias("of"), F.posexplode("known").alias("at", "e"))
    return rows.select("node", "fp", c("e.s").alias("s"), "size", (c("of") - c("at")).alias("left")).filter(c("left") >= SIMILAR * c("size") - 1e-6)


def _enough() -> Column:
    """Whether what is left of two sets from a shared element on can hold what similar sets of their sizes share."""
    return (1 + SIMILAR) * F.least("left", "other_left") >= SIMILAR * (c("size") + c("other_size")) - 1e-6


def spokes(rare: DataFrame) -> DataFrame:
    """Pairs ``u > v`` within ``RADIUS`` bits of all that meet in an element with one of them, a row a member and element."""
    before = F.min(F.struct((c("size") - c("left")).alias("before"), (-c("size")).alias("less"), "node", "fp", "left")).alias("_h")
    hub = written(rare.groupBy("s").agg(before), "hubs")
    hub = hub.select("s", c("_h.node").alias("other"), c("_h.fp").alias("other_fp"), (-c("_h.less")).alias("other_size"), c("_h.left").alias("other_left"))
    met = rare.join(hub, "s").filter((c("node") != c("other")) & (_apart("fp", "other_fp") <= RADIUS) & _enough())
    return met.select(F.greatest("node", "other").alias("u"), F.least("node", "other").alias("v")).distinct()


def _shingled(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, s``: the shingle sets of the wanted texts, a row a text."""

    def run(cols):
        return {"node": cols["node"], "s": [np.sort(shingles(t, SHINGLE).view(np.int64)) for t in cols["text"]]}

    own = docs.select(_text_hash().alias("node"), "text").join(wanted.select(c("node").alias("_kt_node")), c("node") == c("_kt_node"), "left_semi")
    texts = own.groupBy("node").agg(F.first("text").alias("text"))
    return map_columns(texts, run, "node bigint, s array<bigint>")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``u, v`` of texts whose shingles are similar enough."""
    wanted = pairs.select(c("u").alias("node")).union(pairs.select("v")).distinct()
    sets = written(_shingled(docs, wanted), "shingles")
    part = lambda name: sets.select(c("node").alias(name), c("s").alias(f"{name}_s"))
    both = F.size(F.array_intersect("u_s", "v_s"))
    alike = (both >= SIMILAR * (F.size("u_s") + F.size("v_s") - both)) | ((F.size("u_s") == 0) & (F.size("v_s") == 0))
    return written(pairs.join(part("u"), "u").join(part("v"), "v").filter(alike).select("u", "v"), "alike")


def similar_pairs(docs: DataFrame, dense: int = DENSE) -> tuple[DataFrame, DataFrame]:
    """Rows ``doc_id, node`` with a node a text, and verified links ``u, v`` of different texts.

    The groups of the links are those of all pairs within ``RADIUS`` bits; pairs in one group already are not all listed.
    """
    rows = written(_prints(docs), "prints")
    nodes = written(rows.select("node", "fp").distinct(), "nodes")
    near, members = candidates(nodes, dense)
    if members is None:
        return rows, _verified(docs, written(near, "pairs"))
    crowd = written(members, "crowd")
    sets = written(_shingled(docs, crowd.select("node")).join(crowd, "node").select("node", "fp", "s"), "crowd_sets")
    rare = written(rarest(sets), "rarest")
    links = _verified(docs, written(near.unionByName(spokes(rare)).distinct(), "pairs"))
    roots = components(links)
    groups = crowd.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    more = written(apart(rare, groups, ["s"], "node", _enough()), "apart")
    return rows, links if more.isEmpty() else links.unionByName(_verified(docs, more))


def dedup(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; repeated rows of it once."""
    rows, links = similar_pairs(docs, dense)
    known = rows.filter("doc_id IS NOT NULL")
    roots = components(links).select(c("node").alias("_kt_node"), "root")
    placed = known.join(roots, c("node") == c("_kt_node"), "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("_r")).select(c("_r.doc_id").alias("_kt_id"), c("_r.node").alias("_kt_th"))
    first = written(first, "firsts")
    kept = docs.withColumn("_kt_text", _text_hash()).join(first, (c("doc_id") == c("_kt_id")) & (c("_kt_text") == c("_kt_th")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_kt_text"]).drop("_kt_text").unionByName(docs.filter("doc_id IS NULL"))
