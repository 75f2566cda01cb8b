"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts (balanced k-means, then moves of
vertices to the part of most of their neighbours while sizes allow). A small network learns to name the part of a
vector's neighbours. Every row is indexed in its likeliest part; a query is routed to its several likeliest parts,
whose rows are ranked by exact Euclidean distance in double precision. How many parts a query visits is measured
on sample queries: the fewest with which recall reaches TARGET.

One network tells at most MOST_PARTS parts apart. Where ROWS_A_PART asks for more, every part is cut and routed in the
same way once more, by a network of its own that is fitted on a bounded sample of its rows, so parts stay small in
tables a thousand times larger.

Parts are dealt out in blocks of rows and blocks of queries, so no part and no common vector gathers in one task; a
block of rows is copied only for as many blocks of queries as visit its part.

Defined cases: null, zero or non-finite vectors, and vectors of another length than the most of the sample, take
no part; rows of one vec_id count once, with the nearest; null vec_id takes no part; extra columns are ignored; an
empty table gives an empty result. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import hashed_sample, stage

K = 10
MOST_SAMPLED = 8192
ROWS_A_PART = 4096
MOST_PARTS = 256
LEAST_PARTS = 8
TARGET = 0.97
SAMPLE_QUERIES = 512
BLOCK_ROWS = 16_384
BLOCK_QUERIES = 4_096
HIDDEN, EPOCHS, BATCH = 128, 30, 256


def nearest_in(x: np.ndarray, queries: np.ndarray, k: int, step: int = 512) -> np.ndarray:
    """Indices of the k rows of x nearest to each query."""
    norms = (x**2).sum(axis=1)
    out = [np.argpartition(norms - 2 * queries[i : i + step] @ x.T, min(k, len(x)) - 1, axis=1)[:, :k] for i in range(0, len(queries), step)]
    return np.concatenate(out) if out else np.zeros((0, k), int)


def balanced(distance: np.ndarray, room: int) -> np.ndarray:
    """Each row to its nearest centre that has room, rows with the most to lose first."""
    ordered = np.sort(distance, axis=1)
    loss = ordered[:, -1] - ordered[:, 0]
    choice = np.argsort(distance, axis=1)
    left, part = np.full(distance.shape[1], room), np.full(len(distance), -1)
    for i in np.argsort(-loss):
        for j in choice[i]:
            if left[j]:
                part[i], left[j] = j, left[j] - 1
                break
    return part


def cut_graph(x: np.ndarray, neighbours: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 1.1, sweeps: int = 12) -> np.ndarray:
    """A balanced partition of the neighbour graph with few cut edges."""
    room = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)]
    for _ in range(8):
        part = balanced(((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)), room)
        centres = np.stack([x[part == j].mean(axis=0) if (part == j).any() else centres[j] for j in range(parts)])
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), neighbours.shape[1]), part[neighbours].ravel()), 1)
        np.add.at(votes, (neighbours.ravel(), np.repeat(part, neighbours.shape[1])), 1)
        gain = votes.max(axis=1) - votes[np.arange(len(x)), part]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain):
            if gain[i] <= 0:
                break
            to = int(votes[i].argmax())
            if sizes[to] < room:
                sizes[part[i]] -= 1
                sizes[to] += 1
                part[i], moved = to, moved + 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer: log-odds of the parts of a vector's neighbours."""

    shift: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.shift) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit_router(x: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> Router:
    """Adam on the cross-entropy to the shares of parts among each vector's neighbours."""
    d, m = x.shape[1], wanted.shape[1]
    shift, scale = x.mean(axis=0), max(float(x.std()), 1e-12)
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)) / scale, np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, m)), np.zeros(m)]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rates = [0.003 / scale, 0.003, 0.003, 0.003]
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for start in range(0, len(x), BATCH):
            at = order[start : start + BATCH]
            v = x[at] - shift
            h = np.maximum(v @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            g = (z / z.sum(axis=1, keepdims=True) - wanted[at]) / len(at)
            back = (g @ p[2].T) * (h > 0)
            t += 1
            for i, grad in enumerate((v.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                p[i] = p[i] - rates[i] * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Router(shift, *p)


def learn(x: np.ndarray, parts: int, k: int = K, target: float = TARGET, seed: int = 5) -> Router:
    """Partition the sample x, fit the router and measure how many parts to visit."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    x = x[rng.permutation(len(x))]
    parts = max(1, min(parts, len(x) // (2 * k)))
    if parts == 1:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros(d), np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = min(SAMPLE_QUERIES, len(x) // 10)
    queries, base = x[:held], x[held:]
    near = nearest_in(base, base, k + 1)
    part = cut_graph(base, near, parts, rng)
    wanted = np.zeros((len(base), parts))
    np.add.at(wanted, (np.repeat(np.arange(len(base)), near.shape[1]), part[near].ravel()), 1 / near.shape[1])
    router = fit_router(base, wanted, rng)
    placed = router.logits(base).argmax(axis=1)
    rank = np.argsort(np.argsort(-router.logits(queries), axis=1), axis=1)
    visit = rank[np.arange(held)[:, None], placed[nearest_in(base, queries, k)]]
    recall = [(visit < p).mean() for p in range(1, parts + 1)]
    router.probes = next(p for p, r in enumerate(recall, 1) if r >= target or p == parts)
    return router


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """vec_id and vector (array<double>) of the rows that take part."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).filter("vec_id is not null and vector is not null")
    finite = F.forall("vector", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf"))))
    v = v.filter(finite & F.exists("vector", lambda a: a != 0))
    return v if dim is None else v.filter(F.size("vector") == dim)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()) if len(column) else np.zeros((0, 0))


@dataclass
class Index:
    """Routes to parts, and inside them to their parts where there are `inner` routers. A leaf is part * MOST_PARTS + inner part."""

    router: Router
    inner: dict[int, Router]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = self.router.logits(x).argmax(axis=1) * MOST_PARTS
        for part in np.unique(out // MOST_PARTS).tolist() if self.inner else ():
            at = np.flatnonzero(out // MOST_PARTS == part)
            out[at] += self.inner[part].logits(x[at]).argmax(axis=1) if part in self.inner else 0
        return out

    def visits(self, x: np.ndarray, ids: dict[int, int], k: int) -> list[list[int]]:
        """For each query the leaves to visit: the likeliest, and further ones until more than k vec_ids are there."""
        order = np.argsort(-self.router.logits(x), axis=1, kind="stable")
        inside = {part: np.argsort(-r.logits(x), axis=1, kind="stable") for part, r in self.inner.items() if (order[:, : self.router.probes] == part).any()}
        out = []
        for i, parts in enumerate(order.tolist()):
            chosen, there = [], 0
            for rank, part in enumerate(parts):
                inner = self.inner.get(part)
                if rank >= self.router.probes and there > k:
                    break
                subs = [0] if inner is None else inside[part][i].tolist() if part in inside else np.argsort(-inner.logits(x[i : i + 1])[0]).tolist()
                for place, sub in enumerate(subs):
                    if inner is not None and place >= inner.probes and there > k:
                        break
                    leaf = part * MOST_PARTS + sub
                    if ids.get(leaf):
                        chosen.append(leaf)
                        there += ids[leaf]
            out.append(chosen)
        return out


def inner_routers(rows: DataFrame, parts: int, k: int, target: float) -> dict[int, Router]:
    """rows(leaf, vec_id, vector) -> a router for every part, fitted on at most MOST_SAMPLED of its rows."""
    scale = 2**40
    sizes = rows.groupBy("leaf").agg(F.count("*").alias("n"))
    hashed = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(scale))
    some = rows.join(F.broadcast(sizes), "leaf").filter(hashed < F.lit(1.1 * MOST_SAMPLED * scale) / F.col("n"))  # a row a part

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id").head(MOST_SAMPLED)
        router = learn(matrix(frame["vector"]), parts, k, target)
        return pd.DataFrame({"leaf": [int(frame["leaf"].iloc[0])], "router": [pickle.dumps(router)]})

    found = some.groupBy("leaf").applyInPandas(fit, "leaf long, router binary").collect()  # MOST_PARTS at most
    return {r["leaf"] // MOST_PARTS: pickle.loads(r["router"]) for r in found}


def placed(rows: DataFrame, index: Index) -> DataFrame:
    """rows with `leaf`, the likeliest."""

    @F.pandas_udf("long")
    def likeliest(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in vectors:
            yield pd.Series(index.leaf(matrix(part)) if len(part) else np.zeros(0, np.int64))

    return rows.withColumn("leaf", likeliest("vector"))


def rank_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest of rows to each query: a product picks a few more than k, exact distances rank them."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if len(queries) and len(rows):
        rows = rows.sort_values("vec_id", kind="stable")
        x, ids = matrix(rows["vector"]), rows["vec_id"].to_numpy()
        starts = np.unique(ids, return_index=True)[1]
        norms = (x**2).sum(axis=1)
        slack = 1e-9 * (norms.max() + 1)
        for start in range(0, len(queries), 256):
            part = queries.iloc[start : start + 256]
            q, own = matrix(part["vector"]), part["query_id"].to_numpy()
            rough = norms - 2 * q @ x.T
            rough[own[:, None] == ids[None, :]] = np.inf
            least = rough if len(starts) == len(ids) else np.minimum.reduceat(rough, starts, axis=1)  # of each vec_id
            last = np.partition(least, min(k, len(starts)) - 1, axis=1)[:, min(k, len(starts)) - 1]
            for i, limit in enumerate(last):
                at = np.flatnonzero((rough[i] <= limit + slack + 1e-9 * (q[i] ** 2).sum()) & np.isfinite(rough[i]))
                score = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                order = np.lexsort((ids[at], score))
                best, seen = [], set()
                for j in order:
                    if ids[at[j]] not in seen:
                        seen.add(ids[at[j]])
                        best.append(j)
                        if len(best) == k:
                            break
                found.append((np.full(len(best), own[i]), ids[at[best]], score[best]))
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def search(vectors: DataFrame, every: int = 100, k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, its k nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sample = hashed_sample(rows, "vec_id", MOST_SAMPLED).toPandas()  # bounded
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(sample["vector"].map(len).mode().iloc[0])
    rows = stage(usable(vectors, dim).dropDuplicates(["vec_id", "vector"]), "vectors")
    total = rows.count()
    parts = int(np.clip(total // ROWS_A_PART, LEAST_PARTS, MOST_PARTS))
    wanted = total // ROWS_A_PART
    inner = -(-wanted // MOST_PARTS) if wanted > MOST_PARTS else 1
    target = target if inner == 1 else target**0.5
    index = Index(learn(matrix(sample["vector"][sample["vector"].map(len) == dim]), parts, k, target), {})
    if inner > 1:
        index.inner = inner_routers(placed(rows, index), min(inner, MOST_PARTS), k, target)
    leaves = stage(placed(rows, index), "leaves")
    counted = leaves.groupBy("leaf").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids")).collect()  # a row a leaf
    ids, blocks = {r["leaf"]: r["ids"] for r in counted}, {r["leaf"]: -(-r["n"] // BLOCK_ROWS) for r in counted}

    @F.pandas_udf("array<long>")
    def visited(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in vectors:
            yield pd.Series(index.visits(matrix(part), ids, k) if len(part) else [])

    visits = stage(rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", F.explode(visited("vector")).alias("leaf")), "visits")
    asked = {r["leaf"]: -(-r["n"] // BLOCK_QUERIES) for r in visits.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    plan = [(leaf, n, asked[leaf]) for leaf, n in blocks.items() if leaf in asked]  # a row a leaf, MOST_PARTS squared at most
    by_leaf = lambda df: df.join(F.broadcast(spark.createDataFrame(plan, "leaf long, blocks int, rounds int")), "leaf")
    dealt = lambda of, by: F.pmod(F.xxhash64(of), F.col(by).cast("long")).cast("int")
    queries = by_leaf(visits).withColumn("round", dealt("query_id", "rounds")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    there = by_leaf(leaves).withColumn("block", dealt("vec_id", "blocks")).withColumn("round", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)))
    keys = ["leaf", "block", "round"]
    near = queries.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(lambda q, x: rank_block(q, x, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    best = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
