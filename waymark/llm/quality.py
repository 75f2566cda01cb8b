"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text alone (never from labels, lang, source or doc_id). Trees are grown level by
level on binned statistics with logistic loss, then flattened into arrays of complete binary trees: a document's
node at the next level is 2 * node + 1 + (value > threshold), for all documents and one tree at a time in numpy.

The trees are fitted on a bounded sample: MOST_TRAINED labelled rows, those whose doc_id hashes lowest
among the rows that may be learnt from. Everything is scored.

Defined cases: null text is the empty text, scored like any other; rows may repeat, each is scored; labels that
are null, other than 0 and 1, or of unknown documents are left aside; without both labels among the rows to learn
from the score is the constant share of label 1 (0.5 with none); of several labels of a document the greater counts, of
several texts under one doc_id the one of the least hash is learnt from; extra columns are ignored by score(), kept by keep().
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free, hashed_sample, text_column

MOST_TRAINED = 20_000
FOLDS = 5
THRESHOLD = 0.3
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 80, 4, 0.12, 64, 10, 1.0

#: The statistics, in the order of the columns.
STATISTICS = (
    "log_chars", "log_words", "mean_word", "std_word", "share_upper", "share_digit", "share_space", "share_newline", "share_symbol", "share_stop", "share_pipe", "share_bang", "share_nonascii",
    "distinct_words", "repeated_next", "top_word", "upper_words", "symbol_words", "distinct_lines", "top_line_share", "mean_line", "short_lines", "stopped_lines", "distinct_pairs", "compressed", "longest_word", "capital_words",
)
CLASSES = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 sentence mark, 7 other mark, 8 beyond ASCII
for low, high, kind in ((97, 122, 1), (65, 90, 2), (48, 57, 3), (32, 32, 4), (9, 9, 4), (10, 13, 5), (128, 255, 8)):
    CLASSES[low : high + 1] = kind
CLASSES[[c for c in range(33, 127) if not CLASSES[c]]] = 7
for c in b".,;:?'-":
    CLASSES[c] = 6
MARKED = re.compile(r"[#$%&*|!]{2}").search
#: Bytes of a text that are compressed at once; a long text's ratio is that of all its pieces.
PIECE = 1 << 15


def statistics_of(text: str) -> list[float]:
    raw = text.encode()
    kinds = np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=9) / max(1, len(raw))
    words = text.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = set(words)
    following = list(zip(words, words[1:], strict=False))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    by_line: dict[str, int] = {}
    for x in lines:
        by_line[x] = by_line.get(x, 0) + 1
    packed = sum(len(zlib.compress(raw[i : i + PIECE], 1)) for i in range(0, len(raw), PIECE))
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(sizes.mean()), float(sizes.std()), kinds[2], kinds[3], kinds[4], kinds[5], kinds[7], kinds[6], raw.count(b"|") / max(1, len(raw)), raw.count(b"!") / max(1, len(raw)), kinds[8],
        len(distinct) / n, sum(a == b for a, b in following) / n, max(counts.values(), default=0) / n, sum(map(str.isupper, words)) / n, sum(1 for w in distinct if MARKED(w)) / max(1, len(distinct)),
        len(by_line) / m, max(by_line.values(), default=0) / m, float(np.log1p(len(text) / m)), sum(len(x) < 20 for x in lines) / m, sum(x.rstrip()[-1] in ".!?" for x in lines) / m,
        len(set(following)) / max(1, len(following)), packed / max(1, len(raw)), float(np.log1p(sizes.max())), sum(map(str.istitle, distinct)) / max(1, len(distinct)),
    ]


def statistics_frame(texts: pd.Series) -> np.ndarray:
    return np.array([statistics_of(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


@dataclass
class Forest:
    """Complete binary trees as arrays: feature and threshold of TREES x (2**DEPTH - 1) nodes, value of the leaves."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Trees for labels y (0 or 1); each split maximises the usual gain of second-order boosting."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros((0, inner))
        return Forest(float(np.log(share / (1 - share))), none.astype(np.int64), none, np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    k = x.shape[1]
    base = float(np.log(share / (1 - share)))
    raw = np.full(len(y), base)
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, here = 2**level - 1, 2**level
            at = node - first
            key = at[:, None] * (k * BINS) + np.arange(k) * BINS + binned
            total = lambda w: np.bincount(key.ravel(), np.repeat(w, k), here * k * BINS).reshape(here, k, BINS)
            gs, hs, ns = (np.cumsum(total(w), axis=2) for w in (g, h, np.ones(len(y))))
            ga, ha, na = gs[:, :, -1:], hs[:, :, -1:], ns[:, :, -1:]
            gain = gs**2 / (hs + PENALTY) + (ga - gs) ** 2 / (ha - hs + PENALTY) - ga**2 / (ha + PENALTY)
            gain[(ns < LEAST_ROWS) | (na - ns < LEAST_ROWS)] = 0
            best = gain.reshape(here, -1).argmax(axis=1)
            for i in range(here):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    forest.feature[t, first + i], forest.threshold[t, first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), forest.feature[t, node]] > forest.threshold[t, node])
        leaf = node - inner
        forest.value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + PENALTY)
        raw += forest.value[t, leaf]
    return forest


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> Forest:
    """A forest from labelled documents outside the held-out fold, at most `most` of them."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0))
    sample = hashed_sample(usable.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", most)
    texts = docs.select("doc_id", text_column().alias("text"), F.xxhash64(text_column()).alias("h")).join(F.broadcast(sample), "doc_id")  # `most` rows of 12 bytes

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = statistics_frame(frame["text"])
            yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "h": frame["h"], "x": list(x)})

    measured = texts.mapInPandas(measure, "doc_id long, quality int, h long, x array<double>")
    rows = measured.groupBy("doc_id", "quality").agg(F.min_by("x", "h").alias("x")).orderBy("doc_id").toPandas()
    return fit(np.array(rows["x"].tolist(), float).reshape(len(rows), len(STATISTICS)), rows["quality"].to_numpy(float))


def scores(text: Column, forest: Forest) -> Column:
    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(forest.score(statistics_frame(part)))

    return scored(text)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    forest = train(docs, labels)
    scored = docs.select("doc_id", scores(text_column(), forest).alias("score"))
    return scored.select("doc_id", (F.coalesce(fold_of(F.col("doc_id")), F.lit(1)) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with their columns."""
    forest = train(docs, labels)
    scored = free(docs, "_score")
    return docs.withColumn(scored, scores(text_column(), forest)).filter(F.col(scored) >= threshold).select(*docs.columns)
