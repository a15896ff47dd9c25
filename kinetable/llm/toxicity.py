"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated isotonically.

The bounded training sample (``labels.SAMPLE_PER_CLASS`` a class) is split by document: one part
learns the lexicon (log-odds of words and word beginnings, also in spellings freed of look-alike
letters), one grows the trees on densities of that lexicon, closeness to second-person words,
capitals, punctuation and obfuscation rates, and one fits the isotonic calibration.

Null and empty texts have zero features and are scored like any other; without labels of both
classes every text gets the share of label 1.  Repeated rows give repeated results.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetable.llm.common import ids_and_text, map_columns
from kinetable.llm.labels import SAMPLE_PER_CLASS, held_out, training_texts

KEY_BITS, SUPPORT, LEAST_ODDS, CAUTION = 22, 4, 0.5, 1.5
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 80, 3, 0.2, 32, 20
CACHE_ENTRIES, NEAR, IMAGINED = 200_000, 5, 10
LOOKALIKES = str.maketrans("0134578@$!|+", "oieastbasiit")
YOU = frozenset("you your yours yourself u ur tu te ti tus toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch usted ustedes vosotros".split())
_EDGES = re.compile(r"^\W+|\W+$")
_INNER = re.compile(r"[\W_]+")


def word_keys(token: str) -> list[int]:
    """Hashed forms of a token: the word, its beginnings, and the same without look-alikes and marks inside."""
    low = token.lower()
    plain = _EDGES.sub("", low)
    bare = _INNER.sub("", low.translate(LOOKALIKES))
    forms = {f"{n}:{w[:n]}" for w in {plain, bare} if w for n in (4, 5, 6) if len(w) >= n}
    forms |= {f"w:{w}" for w in {plain, bare} if w}
    return [zlib.crc32(f.encode()) >> (32 - KEY_BITS) for f in forms]


def learn_lexicon(rows: list[dict]) -> dict[int, float]:
    """Log-odds of keys that at least ``SUPPORT`` toxic documents hold, less ``CAUTION`` standard errors."""
    n = [sum(1 for r in rows if r["y"] == y) for y in (0, 1)]
    seen = [np.zeros(1 << KEY_BITS, np.int32) for _ in (0, 1)]
    for r in rows:
        seen[r["y"]][np.asarray(r["keys"], np.int64)] += 1
    odds = np.log((seen[1] + 0.1) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    odds -= CAUTION * np.sqrt(1 / (seen[1] + 0.1) + 1 / (seen[0] + 0.5))
    keep = np.flatnonzero((seen[1] >= SUPPORT) & (odds >= LEAST_ODDS))
    return dict(zip(keep.tolist(), odds[keep].tolist()))


class TokenTable(dict):
    """Row number of a token; a row: lexicon odds, second person, capitals, obfuscation, marks, shouting."""

    def __init__(self, lexicon: dict[int, float]):
        self.lexicon = lexicon
        self.rows = np.zeros((1024, 6))

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.rows[at]

    def __missing__(self, token: str) -> int:
        odds = max((self.lexicon.get(k, 0.0) for k in word_keys(token)), default=0.0)
        core = _EDGES.sub("", token)
        letters = sum(map(str.isalpha, core))
        odd = bool(letters) and letters < len(core) and not core.replace("-", "").replace("'", "").isalpha()
        marks = len(token) - len(core)
        at = self[token] = len(self)
        if at >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = (odds, core.lower() in YOU, letters > 1 and core.isupper(), odd, marks, "!" in token or "?" in token)
        return at


FEATURES = 15


def dense(text: str, table: TokenTable) -> np.ndarray:
    tokens = text.split()
    out = np.zeros(FEATURES)
    n = len(tokens)
    if not n:
        return out
    m = table.of(tokens)
    odds = m[:, 0]
    strong, weak = np.flatnonzero(odds >= 3.0), odds >= 2.0
    out[0] = np.log1p(n)
    out[1:3] = len(strong) / n, weak.sum() / n
    out[3:5] = np.log1p(len(strong)), np.log1p(weak.sum())
    top = np.sort(odds)[-3:]
    out[5:8] = top[-1], top.mean(), odds.mean()
    you = np.flatnonzero(m[:, 1])
    if len(strong) and len(you):
        near = np.searchsorted(you, strong)
        gap = np.minimum(np.abs(strong - you[np.minimum(near, len(you) - 1)]), np.abs(strong - you[np.maximum(near - 1, 0)]))
        out[8] = (gap <= NEAR).sum() / n
    out[9:14] = m[:, 1].mean(), m[:, 2].mean(), m[:, 3].mean(), m[:, 4].mean(), m[:, 5].mean()
    out[14] = (m[1:, 3] * weak[1:]).sum() / n
    return out


@dataclass
class Trees:
    """Boosted trees of equal depth as arrays: feature, threshold and leaf value of each node."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        at = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[at, f[node]] > t[node])
            z += leaf[node - len(f)]
        return z


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Newton boosting of the logistic loss with histogram splits."""
    inner = (1 << DEPTH) - 1
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    z = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p) + 1e-9
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            inside = node == k
            if inside.sum() >= 2 * LEAST_ROWS:
                best = 1e-6
                gi, hi, total_g, total_h = g[inside], h[inside], g[inside].sum(), h[inside].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = bins[inside, j]
                    gl = np.cumsum(np.bincount(b, gi, len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hi, len(c) + 1))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    gain[(nl < LEAST_ROWS) | (inside.sum() - nl < LEAST_ROWS)] = 0
                    if gain.max() > best:
                        best, feature[k], threshold[k] = gain.max(), j, c[gain.argmax()]
            node = np.where(inside, 2 * k + 1 + (x[:, feature[k]] > threshold[k]), node)
        at = node - inner
        leaf = RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
        z += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing values, each pool with ``IMAGINED`` rows of the classes' shares."""
    share = float((y * weight).sum() / weight.sum())
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []
    for zi, yi, wi in zip(z[order].tolist(), y[order].tolist(), weight[order].tolist()):
        pools.append([yi * wi, wi, zi, zi])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = np.array([k for p in pools for k in (p[2], p[3])])
    values = np.array([(p[0] + IMAGINED * share) / (p[1] + IMAGINED) for p in pools for _ in (0, 1)])
    return knots, np.maximum.accumulate(values)


@dataclass
class Model:
    lexicon: dict[int, float]
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list, table: TokenTable) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.values[0])
        z = self.trees.raw(np.array([dense(t or "", table) for t in texts]).reshape(len(texts), FEATURES))
        return np.interp(z, self.knots, self.values)


def prepared(cols):
    """Distinct word keys of each training text, and the text for the dense features."""
    keys = [sorted({k for t in set((t or "").split()) for k in word_keys(t)}) for t in cols["text"]]
    return {"doc_id": cols["doc_id"], "y": cols["y"], "keys": keys}


def part_of(doc_id) -> int:
    """0, 1: lexicon and trees; 2: calibration.  By document, so no text is in two parts."""
    return (0, 0, 1, 1, 2)[zlib.crc32(f"part {doc_id}".encode()) % 5]


def fit_rows(rows: list[dict], features_of, counts: dict[int, int]) -> Model:
    """``rows``: doc_id, y, keys.  ``features_of(lexicon)``: dense features by row, in the same order."""
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    groups = [[r for r in rows if part_of(r["doc_id"]) == k] for k in (0, 1, 2)]
    if not all(any(r["y"] == y for r in g) for g in groups for y in (0, 1)):
        return Model({}, None, np.zeros(1), np.array([(n1 + 0.5) / (n0 + n1 + 1)]))
    lexicon = learn_lexicon(groups[0])
    x, y = features_of(lexicon), np.array([r["y"] for r in rows], float)
    part = np.array([part_of(r["doc_id"]) for r in rows])
    trees = boost(x[part == 1], y[part == 1])
    used = [sum(1 for r in rows if r["y"] == k) for k in (0, 1)]
    weight = np.where(y == 1, n1 / used[1], n0 / used[0])
    knots, values = isotonic(trees.raw(x[part == 2]), y[part == 2], weight[part == 2])
    return Model(lexicon, trees, knots, values)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Two passes over the bounded sample: word keys first, dense features once there is a lexicon."""
    sample, counts = training_texts(docs, labels, "toxic", per_class)
    kind = sample.schema["doc_id"].dataType.simpleString()
    sample = sample.select("doc_id", "text", "y").cache()
    try:
        keyed = map_columns(sample, prepared, f"doc_id {kind}, y int, keys array<int>")
        rows = sorted((r.asDict() for r in keyed.toLocalIterator()), key=lambda r: (r["doc_id"], r["y"], r["keys"]))

        def features_of(lexicon):
            def run(cols):
                table = TokenTable(lexicon)
                keys = prepared(cols)["keys"]
                return {"doc_id": cols["doc_id"], "y": cols["y"], "keys": keys, "x": [dense(t or "", table).tolist() for t in cols["text"]]}

            found = map_columns(sample, run, f"doc_id {kind}, y int, keys array<int>, x array<double>").toLocalIterator()
            ordered = sorted((r.asDict() for r in found), key=lambda r: (r["doc_id"], r["y"], r["keys"]))
            return np.array([r["x"] for r in ordered])

        return fit_rows(rows, features_of, counts)
    finally:
        sample.unpersist()


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tables: dict[int, TokenTable] = {}

    def run(cols):
        if 0 not in tables:
            tables[0] = TokenTable(shared.value.lexicon)
        return {"doc_id": cols["doc_id"], "score": shared.value.scores(cols["text"], tables[0])}

    rows = ids_and_text(docs)
    scored = map_columns(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
