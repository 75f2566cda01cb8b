"""Vector code compression: product quantisation with codebooks in whole numbers.

Components are read as floor(256 * x), in 64-bit integers. Each of PARTS equal parts of a vector has a codebook of up to
ENTRIES entries, at first that part of the vectors of least vec_id. Every round builds a kd-tree over each codebook and
broadcasts them (PARTS * ENTRIES entries, whatever the data's size); tasks search them by branch and bound for a block of
vectors at once and hand on one sum and count an entry, in integers, so that any order of addition gives the same; the
sums are added by an exchange of at most PARTS * ENTRIES rows a task, and what comes to the driver are the new entries.

The search descends to the nearer side first and enters the other unless its least possible distance is greater than the
best so far. A side that could only equal the best is entered, as it may hold an entry of lower index at the same
distance; (distance, index) is the order that decides.

Defined cases: vectors that are null or hold null or non-finite components take no part; neither do vectors of another
length than that of the least vec_id (none can be cut alike); a length that PARTS does not divide, or a component beyond
2^21, raises an error, as exact codes do not exist; fewer than ENTRIES vectors give as many entries; vec_ids that repeat
or are null stay rows of their own (null is the greatest, repeats are in order of their components); null labels count as
one label; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import stage

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 4
#: Labels counted up to this many (32 bytes each) have their totals broadcast; more are joined by salted keys.
MOST_BROADCAST, SALTS = 100_000, 16
#: Vectors searched at once.
BLOCK = 8192
FAR = np.iinfo(np.int64).max


@dataclass
class Tree:
    """A kd-tree over a codebook: inner nodes split entries at the median of their widest component."""

    entries: np.ndarray  # of this node: their places, ascending
    low: np.ndarray
    high: np.ndarray
    sides: tuple[Tree, Tree] | None


def built(book: np.ndarray, places: np.ndarray | None = None) -> Tree:
    places = np.arange(len(book)) if places is None else places
    inside = book[places]
    low, high = inside.min(axis=0), inside.max(axis=0)
    if len(places) <= LEAF or (low == high).all():
        return Tree(places, low, high, None)
    order = places[np.argsort(inside[:, np.argmax(high - low)], kind="stable")]
    half = len(order) // 2
    return Tree(places, low, high, (built(book, np.sort(order[:half])), built(book, np.sort(order[half:]))))


def least_possible(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The squared distance from each point to the node's box; nothing in it is nearer."""
    out = np.maximum(0, np.maximum(tree.low - points, points - tree.high))
    return np.einsum("ij,ij->i", out, out)


def search(tree: Tree, book: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of every point's nearest entry, ties to the lower index."""
    index, best = np.full(len(points), len(book)), np.full(len(points), FAR)

    def visit(node: Tree, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.sides is None:
            apart = points[rows, None, :] - book[node.entries]
            found = np.einsum("ijk,ijk->ij", apart, apart)
            first = found.argmin(axis=1)  # the lowest place of equal ones
            d, i = found[np.arange(len(rows)), first], node.entries[first]
            better = (d < best[rows]) | ((d == best[rows]) & (i < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], i[better]
            return
        left, right = node.sides
        to_left, to_right = least_possible(left, points[rows]), least_possible(right, points[rows])
        near_left = to_left <= to_right
        for near, far, here, bound in ((left, right, near_left, to_right), (right, left, ~near_left, to_left)):
            mine = rows[here]
            visit(near, mine)
            visit(far, mine[bound[here] <= best[mine]])  # equal bounds too: a lower index may tie

    visit(tree, np.arange(len(points)))
    return index, best


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x) of vectors of this length, as a matrix."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE)
    if len(whole) and np.abs(whole).max() >= SCALE << 21:
        raise ValueError("a component beyond 2^21 has no exact code")
    return whole.astype(np.int64).reshape(len(vectors), width)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part, of whatever length."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embeddings.select("vec_id", "label", F.col("embedding").alias("vector")).filter(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(True)))


def parts_of(matrix: np.ndarray, parts: int) -> np.ndarray:
    """Vectors' parts: (part, vector, component)."""
    return matrix.reshape(len(matrix), parts, -1).transpose(1, 0, 2)


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, integers(part.column(part.schema.get_field_index("vector")), width)


def sums(rows: DataFrame, shared, width: int, parts: int) -> DataFrame:  # noqa: ANN001
    """part, entry, n, total of the vectors' parts that are nearest to each entry; total by component."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        n = np.zeros((parts, books.shape[1]), np.int64)
        total = np.zeros(books.shape, np.int64)
        for _, matrix in matrices(batches, width):
            for p, points in enumerate(parts_of(matrix, parts)):
                index, _ = search(trees[p], books[p], points)
                n[p] += np.bincount(index, minlength=n.shape[1])
                np.add.at(total[p], index, points)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({"part": part, "entry": entry, "n": n[part, entry], "total": pa.array(list(total[part, entry]), pa.list_(pa.int64()))})

    found = rows.select("vector").mapInArrow(added, "part long, entry long, n long, total array<long>")
    size = width // parts
    summed = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(size)))
    return summed.select("part", "entry", "n", F.array(*(F.col(f"t{i}") for i in range(size))).cast("array<long>").alias("total"))


def shared_trees(rows: DataFrame, books: np.ndarray):  # noqa: ANN201
    return rows.sparkSession.sparkContext.broadcast((books, [built(b) for b in books if len(b)]))  # PARTS * ENTRIES entries


def fitted(rows: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of rows(vec_id, vector) of this length."""
    first = rows.select(F.col("vec_id").isNull().alias("last"), "vec_id", "vector").orderBy("last", "vec_id", "vector").limit(entries).collect()
    books = parts_of(integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width), parts).copy()
    for _ in range(rounds):
        shared = shared_trees(rows, books)
        for r in sums(rows, shared, width, parts).collect():  # an entry a row
            books[r["part"], r["entry"]] = np.array(r["total"], np.int64) // r["n"]
        shared.unpersist()
    return books


def coded(rows: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code, error of rows(vec_id, label, vector) by these codebooks."""
    shared, parts = shared_trees(rows, books), len(books)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, trees = shared.value
        for batch, matrix in matrices(batches, width):
            pairs = [search(t, b, p) for t, b, p in zip(trees, books, parts_of(matrix, parts), strict=True)]
            codes = np.stack([i for i, _ in pairs], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in pairs))], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "vector").mapInArrow(assigned, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error: the sum of error over equal labels, nulls together. rows are staged. A label may hold any
    share of the rows: sums are partial before the exchange, and a label's rows are not gathered for the join."""
    totals = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    totals = stage(totals, "totals")
    if totals.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(totals), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_dealt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_dealt") == F.col("_salt"))).drop("_label", "_salt", "_dealt")


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that takes part."""
    if not 0 < entries <= 256:
        raise ValueError("an index must fit one byte")
    rows = usable(embeddings)
    first = rows.select(F.col("vec_id").isNull().alias("last"), "vec_id", "vector").orderBy("last", "vec_id", "vector").limit(1).collect()
    width = len(first[0]["vector"]) if first else 0
    if width % parts or first and not width:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows = rows.filter(F.size("vector") == width)
    books = fitted(rows, width, parts, entries, rounds) if first else np.zeros((parts, 0, 0), np.int64)
    found = stage(coded(rows, books, width), "codes")
    return with_label_errors(found).select("vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))


def restored(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that a code stands for, in the components' own scale."""
    shared = codes.sparkSession.sparkContext.broadcast(books)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.arange(len(shared.value))
        for batch in batches:
            code = np.array([list(bytes.fromhex(c)) for c in batch.column(1).to_pylist()], np.int64).reshape(-1, len(parts))
            vectors = shared.value[parts, code].reshape(len(code), -1) / SCALE
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(looked_up, f"vec_id {dict(codes.dtypes)['vec_id']}, vector array<double>")


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """compress() of embeddings in DuckDB's SQL: every part against every entry."""
    near = lambda r: f"""n{r} AS MATERIALIZED (SELECT id, p, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT x.id, x.p, b.i, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN b{r} b ON b.p = x.p) GROUP BY id, p)"""
    means = lambda r: f"""a{r} AS (SELECT p, i, list(m ORDER BY j) AS v FROM (SELECT p, i, j, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT n.p, n.i, unnest(x.v) AS e, generate_subscripts(x.v, 1) AS j FROM n{r} n JOIN x USING (id, p)) GROUP BY p, i, j) GROUP BY p, i),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(a.v, b.v) AS v FROM b{r} b LEFT JOIN a{r} a USING (p, i))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{means(r)}" for r in range(rounds))
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT id, p, v[len(v) // {parts} * p + 1 : len(v) // {parts} * (p + 1)] AS v FROM k, range({parts}) AS r(p)),
b0 AS (SELECT p, id AS i, v FROM x WHERE id < {entries}),
{steps},
{near(rounds)},
e AS (SELECT id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN k USING (id)"""
