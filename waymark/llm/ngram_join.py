"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A text's set is that of the hashes of all runs of WORDS lower-cased words between white space (of all its words if
it has fewer). Texts of equal sets are one class of copies and are searched once. Each of TREES trees is a sorted
prefix trie: a class's label in it is a sequence of DEEPEST MinHash values, and the table of labels is kept in their
order, so that a prefix of any length is a run of rows. The search begins with whole labels. Classes under a common
prefix are linked, the links' components are the candidate clusters, and inside a cluster all pairs are compared
exactly, in blocks of BLOCK classes: a task holds two blocks at most, counts links by products of 0/1 matrices and puts
out a number per class and a spanning forest, never pairs. Then the recall is measured: a link of similarity s is found
by prefixes of this length with a known probability, so the links found, each by one over its probability, tell how
many there are at most; a link just at the threshold is added, lest few links look complete. While this says less than
RECALL, the prefixes are shortened by a value; of the clusters that then merge, pairs from different ones are compared.

Result: a row per input row: doc_id, class_id (least doc_id of the component of verified links), n_links (other rows
whose sets have at least the threshold's similarity, copies included), copies (rows with this very set).

Defined cases: null text is the empty text; blank texts have an empty set, are copies of each other and link to
nothing else; rows may repeat and count as copies; null doc_id takes part (class_id is null only if all are);
extra columns are ignored by join(), kept by keep_one(); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free, stage, text_column, text_slices, width
from waymark.llm.components import components

WORDS = 5
THRESHOLD = (4, 5)  # as a fraction, so that the comparison is exact
TREES = 16
DEEPEST = 6
RECALL = 0.9995
#: Bits of a MinHash value in a label, and values in the first of a label's two numbers.
BITS, HIGH = 16, 4
#: Classes of similarity, from the threshold to 1, in which found links are counted.
SIMILARITIES = 64
BLOCK = 256
#: Members of small clusters that one task of verification takes together.
BIN = 2048
RANDOM = np.random.default_rng(20240229)
XORS = RANDOM.integers(0, 2**64, TREES * DEEPEST, np.uint64)
ODDS = RANDOM.integers(0, 2**64, TREES * DEEPEST, np.uint64) | np.uint64(1)
STEPS = RANDOM.integers(0, 2**64, max(WORDS, DEEPEST), np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of words."""
    hashes = np.array(list(map(xxhash.xxh3_64_intdigest, (text or "").lower().split())), np.uint64)
    n = len(hashes) - words + 1
    if not len(hashes):
        return hashes
    if n < 1:
        return mixed(np.array([np.sum(hashes * STEPS[: len(hashes)]) + np.uint64(len(hashes))], np.uint64))
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += hashes[i : i + n] * STEPS[i]
    return np.unique(mixed(total))


def chance(similarity: float | np.ndarray, depth: int, trees: int = TREES) -> float | np.ndarray:
    """The chance that sets of this similarity share a prefix of `depth` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def measured_recall(found: np.ndarray, depth: int, threshold: tuple[int, int] = THRESHOLD) -> float:
    """Share of the links that prefixes of this length have found; found: numbers of links by class of similarity."""
    least = threshold[0] / threshold[1]
    similarity = least + (1 - least) * np.arange(SIMILARITIES) / SIMILARITIES
    return float((found.sum() + 1) / ((found / chance(similarity, depth)).sum() + 1 / chance(least, depth)))


def labels(values: np.ndarray, deepest: int = DEEPEST, trees: int = TREES) -> np.ndarray:
    """For each tree the label of the set: its first HIGH MinHash values in one number, the others in a second."""
    out = np.zeros((2, trees), np.uint64)
    for level in range(deepest):
        at = slice(level * trees, (level + 1) * trees)
        least = np.full(trees, 2**64 - 1, np.uint64)
        for start in range(0, len(values), 4096):
            np.minimum(least, ((values[start : start + 4096, None] ^ XORS[at]) * ODDS[at]).min(axis=0), out=least)
        place = HIGH - 1 - level % HIGH
        out[level // HIGH] |= (mixed(least) >> np.uint64(64 - BITS)) << np.uint64(BITS * place)
    return out


def prefix(high: Column, low: Column, depth: int) -> tuple[Column, Column]:
    """The first `depth` values of labels, as two numbers."""
    cut = lambda x, keep: F.lit(0).cast("long") if keep <= 0 else F.shiftrightunsigned(x, BITS * (HIGH - min(keep, HIGH)))
    return cut(high, depth), cut(low, depth - HIGH)


def text_hash() -> Column:
    return F.unhex(F.md5(text_column().cast("binary")))


LABELS = [f"{x}{i}" for x in "hl" for i in range(TREES)]


def signatures(docs: DataFrame) -> DataFrame:
    """uid, doc_id, h (of the text), digest (of the set), n, h0.., l0.. (a label per tree; 0 for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            digests, sizes, keys = [], [], np.zeros((part.num_rows, 2 * TREES), np.int64)
            for i, text in enumerate(part.column(3).to_pylist()):
                values = shingles(text)
                digests.append(xxhash.xxh3_128_digest(values.tobytes()))
                sizes.append(len(values))
                if len(values):
                    keys[i] = labels(values).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(k)) for k in keys.T)], names=["uid", "doc_id", "h", "digest", "n", *LABELS])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), text_column().alias("text"))
    return rows.mapInArrow(sign, "uid long, doc_id long, h binary, digest binary, n long, " + ", ".join(f"{k} long" for k in LABELS))


def forest(classes: DataFrame) -> DataFrame:
    """classes(node, n, h0.., l0..) -> (tree, high, low, node), the labels of each tree in order."""
    label = F.array(*(F.struct(F.lit(i).alias("tree"), F.col(f"h{i}").alias("high"), F.col(f"l{i}").alias("low")) for i in range(TREES)))
    rows = classes.filter("n > 0").select("node", F.explode(label).alias("label")).select("label.*", "node")
    return rows.repartitionByRange(width(classes.sparkSession), "tree", "high", "low", "node").sortWithinPartitions("tree", "high", "low")


def merged(trees: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """roots(node, root) -> (node, before, cluster) of the classes whose clusters merge by prefixes of this length."""
    high, low = prefix(F.col("high"), F.col("low"), depth)
    placed = trees.join(roots, "node").select("tree", high.alias("p"), low.alias("q"), "root")
    shared = placed.groupBy("tree", "p", "q").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most")
    links = placed.join(shared, ["tree", "p", "q"]).filter("root != least").select(F.col("root").alias("u"), F.col("least").alias("v"))
    found = components(links).select(F.col("id").alias("root"), F.col("root").alias("cluster"))
    return roots.join(found, "root").select("node", F.col("root").alias("before"), "cluster")


def intersections(a: list[np.ndarray], b: list[np.ndarray], most_cells: int = 4_000_000) -> np.ndarray:
    """How many values each set of a shares with each of b, by products of 0/1 matrices over the shared values."""
    sizes_a, sizes_b = [len(x) for x in a], [len(x) for x in b]
    left, right = np.concatenate(a), np.concatenate(b)
    seen = np.intersect1d(left, right)  # sorted
    shared = np.zeros((len(a), len(b)), np.float32)
    rows, others = np.repeat(np.arange(len(a)), sizes_a), np.repeat(np.arange(len(b)), sizes_b)
    at, there = np.searchsorted(seen, left), np.searchsorted(seen, right)
    own = (at < len(seen)) & (seen[np.minimum(at, len(seen) - 1)] == left) if len(seen) else np.zeros(len(left), bool)
    theirs = (there < len(seen)) & (seen[np.minimum(there, len(seen) - 1)] == right) if len(seen) else np.zeros(len(right), bool)
    rows, at, others, there = rows[own], at[own], others[theirs], there[theirs]
    step = max(1, most_cells // max(len(a), len(b)))
    for start in range(0, len(seen), step):
        width = min(step, len(seen) - start)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        mine, his = (at >= start) & (at < start + width), (there >= start) & (there < start + width)
        x[rows[mine], at[mine] - start] = 1
        y[others[his], there[his] - start] = 1
        shared += x @ y.T
    return shared


def linked(a: list[np.ndarray], b: list[np.ndarray], fresh: np.ndarray, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the fresh pairs are links, and their similarities."""
    link = np.zeros(fresh.shape, bool)
    rows, columns = np.flatnonzero(fresh.any(axis=1)), np.flatnonzero(fresh.any(axis=0))
    if not len(rows):
        return link, np.zeros(0)
    x, y = [a[i] for i in rows], [b[i] for i in columns]
    both = intersections(x, y).astype(np.int64)
    union = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None, :] - both
    good = (both * threshold[1] >= threshold[0] * union) & fresh[np.ix_(rows, columns)]
    link[np.ix_(rows, columns)] = good
    return link, both[good] / union[good]


def spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A forest (child, parent) of the graph of index pairs on n points."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in pairs.tolist():
        p, q = find(i), find(j)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((max(p, q), min(p, q)))
    return out


CHECKED = "node long, other long, links long, similarity int"


def compare(frame: pd.DataFrame, threshold: tuple[int, int] = THRESHOLD) -> pd.DataFrame:
    """The rows of one task, by cluster; block pairs come with the side of each row. Pairs that were in one cluster
    before are done. Out: node, other, links; and for each class of similarity (node and other are null) how many
    links were found."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    found = np.zeros(SIMILARITIES, np.int64)
    least = threshold[0] / threshold[1]

    def links(x: list[np.ndarray], y: list[np.ndarray], fresh: np.ndarray, times: int) -> np.ndarray:
        link, similarity = linked(x, y, fresh, threshold)
        kind = np.clip((similarity - least) / (1 - least) * SIMILARITIES, 0, SIMILARITIES - 1).astype(int)
        found[:] += np.bincount(kind, minlength=SIMILARITIES) // times
        return link

    for _, part in frame.groupby("cluster", sort=False):
        nodes, copies, side = part["node"].to_numpy(), part["copies"].to_numpy(), part["side"].to_numpy()
        sets = [np.asarray(x, np.int64) for x in part["values"]]
        before = part["before"].to_numpy()
        if side.max() == 0:
            link = links(sets, sets, before[:, None] != before[None, :], 2)
            counts, pairs = link @ copies, np.argwhere(np.triu(link))
        else:
            first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(first) or not len(second):
                continue
            link = links([sets[i] for i in first], [sets[i] for i in second], before[first][:, None] != before[second][None, :], 1)
            counts = np.zeros(len(nodes), np.int64)
            counts[first], counts[second] = link @ copies[second], copies[first] @ link
            hits = np.argwhere(link)
            pairs = np.stack([first[hits[:, 0]], second[hits[:, 1]]], axis=1)
        hit = np.flatnonzero(counts)
        out.append((nodes[hit], nodes[hit], counts[hit]))
        if edges := spanning(pairs, len(nodes)):
            child, parent = np.array(edges).T
            out.append((nodes[child], nodes[parent], np.zeros(len(child), np.int64)))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    table = pd.DataFrame(dict(zip(("node", "other", "links"), columns, strict=True))).astype("Int64").assign(similarity=pd.array([pd.NA] * len(columns[0]), "Int32"))
    seen = np.flatnonzero(found)
    if not len(seen):
        return table
    none = pd.array([pd.NA] * len(seen), "Int64")
    return pd.concat([table, pd.DataFrame({"node": none, "other": none, "links": pd.array(found[seen], "Int64"), "similarity": pd.array(seen, "Int32")})])


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(node, doc_id, h, before, cluster, copies) with the set itself as `values`, made again from the text."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("h"), text_column().alias("text")).alias("t")
    w = wanted.alias("w").hint("merge")
    pairs = texts.join(w, F.col("t.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("t.h") == F.col("w.h"))).select("node", "before", "cluster", "copies", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            values = [shingles(t).view(np.int64) for t in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(values, pa.list_(pa.int64()))], names=["node", "before", "cluster", "copies", "values"])

    return pairs.mapInArrow(make, "node long, before long, cluster long, copies long, values array<long>").dropDuplicates(["node"])


def verified(docs: DataFrame, classes: DataFrame, clusters: DataFrame) -> DataFrame:
    """CHECKED: partial numbers of links (other is node), the links of a spanning forest, and numbers by similarity."""
    members = classes.select("node", "doc_id", "h", "copies").join(clusters, "node")
    sets = stage(sets_of(docs, members), "sets")
    sizes = sets.groupBy("cluster").agg(F.count("*").alias("size"))
    placed = sets.join(sizes, "cluster").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    bins = max(1, -(-sets.count() // BIN))
    row = ("cluster", "node", "before", "copies", "values")
    small = placed.filter("blocks = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("task"), F.lit(0).alias("i"), F.lit(0).alias("j"), *row, F.lit(0).alias("side"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    large = placed.filter("blocks > 1").withColumn("block", block).withColumn("with", other)
    large = large.select((-F.col("cluster") - 1).alias("task"), F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), *row, (F.col("block") > F.col("with")).cast("int").alias("side"))
    return small.unionByName(large).groupBy("task", "i", "j").applyInPandas(lambda frame: compare(frame), CHECKED)


def search(docs: DataFrame, classes: DataFrame, recall: float) -> DataFrame:
    """CHECKED over all lengths of prefixes that the recall asks for, the longest first."""
    spark, trees = docs.sparkSession, stage(forest(classes), "forest")
    roots = classes.filter("n > 0").select("node", F.col("node").alias("root"))
    found, checked = np.zeros(SIMILARITIES, np.int64), None
    for depth in range(DEEPEST, 0, -1):
        clusters = stage(merged(trees, roots, depth), "clusters")
        now = stage(spark.createDataFrame([], CHECKED) if clusters.isEmpty() else verified(docs, classes, clusters), "verified")
        checked = now if checked is None else checked.unionByName(now)
        for r in now.filter("node is null").groupBy("similarity").agg(F.sum("links").alias("n")).collect():
            found[r["similarity"]] += r["n"]
        if measured_recall(found, depth) >= recall:
            break
        roots = stage(roots.join(clusters.select("node", "cluster"), "node", "left").select("node", F.coalesce("cluster", "root").alias("root")), "roots")
    return checked.filter("node is not null")


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, copies for every row of docs."""
    return joined(docs, recall).select("doc_id", "class_id", "n_links", "copies")


def joined(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    signed = stage(signatures(docs), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    grouped = signed.groupBy("digest").agg(F.min("uid").alias("node"), first, F.count("*").alias("copies"), F.max("n").alias("n"), *(F.max(k).alias(k) for k in LABELS))
    classes = stage(grouped.select("digest", "node", "first.doc_id", "first.h", "copies", "n", *LABELS), "classes")
    checked = search(docs, classes, recall)
    links = checked.filter("node = other").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(checked.filter("node != other").select(F.col("node").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "node")
    known = classes.select("digest", "node", "doc_id", "copies").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    known = known.join(least, "root").select("digest", "root", "copies", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("uid", "doc_id", "h", "digest").join(known, "digest")


def keep_one(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The rows of docs, one of each class: that of the least doc_id (null last), then of the least hash of its text."""
    rows = joined(docs, recall).groupBy("root", "doc_id", "h").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("least")
    own, own_h = free(docs, "_id"), free(docs, "_hash")
    found = stage(rows.groupBy("root").agg(least).select(F.col("least.doc_id").alias(own), F.col("least.h").alias(own_h), F.col("least.n").alias("n")), "kept")
    # both lists grow with the input: never broadcast, whatever the size
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (text_hash() == F.col(own_h))
    kept = docs.join(found.select(own, own_h).hint("merge"), same, "left_semi")
    if found.filter("n > 1").isEmpty():
        return kept
    # rows that repeat with id and text
    return kept.withColumn(own_h, text_hash()).dropDuplicates(["doc_id", own_h]).drop(own_h)
