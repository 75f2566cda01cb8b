import hashlib
import math

import duckdb
import numpy as np
import pytest

from waymark.llm import codes


def brute(rows, parts, entries, rounds):
    """compress() of (vec_id, label, vector) rows in Python's own numbers."""
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(good[0][2]) // parts
    whole = [[math.floor(256 * x) for x in r[2]] for r in good]
    cut = [[v[p * size : (p + 1) * size] for v in whole] for p in range(parts)]
    books = [[list(v) for v in cut[p][:entries]] for p in range(parts)]
    near = lambda p, v: min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            picked = [near(p, v)[1] for v in cut[p]]
            for i in set(picked):
                mine = [v for v, j in zip(cut[p], picked) if i == j]
                books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [[near(p, cut[p][k]) for p in range(parts)] for k in range(len(good))]
    by_label = {}
    for r, f in zip(good, found):
        by_label[r[1]] = by_label.get(r[1], 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), by_label[r[1]], digest) for r, f in zip(good, found)], key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_search_keeps_the_lower_index_of_ties(spread):
    rng = np.random.default_rng(spread)
    for size in (1, 2, 5):
        for n in (1, 3, 64, 200):
            book, points = rng.integers(-spread, spread + 1, (n, size)), rng.integers(-spread, spread + 1, (500, size))
            apart = ((points[:, None] - book) ** 2).sum(axis=2)
            index, best = codes.search(codes.built(book), book, points)
            assert (index == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()


def test_some_branches_are_never_entered(monkeypatch):
    rng = np.random.default_rng(0)
    book, points = rng.integers(-10_000, 10_000, (64, 2)), rng.integers(-10_000, 10_000, (300, 2))
    seen, plain = [], np.einsum
    monkeypatch.setattr(codes.np, "einsum", lambda spec, *a: (seen.append(a[0].shape[0] * a[0].shape[1]) if spec.startswith("ijk") else None, plain(spec, *a))[1])
    codes.search(codes.built(book), book, points)
    assert sum(seen) < 300 * 64 / 2


def test_query_against_brute_force_and_sql(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    found = got(codes.compress(table))
    assert found == brute(rows, 16, 64, 2)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert found == sorted(con.execute(codes.oracle_sql()).fetchall(), key=str)


ODD = "vec_id long, embedding array<float>, label int, code string, _label int, _salt int, n long"


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i % 37, [float(x) for x in rng.integers(-3, 4, 4) / 2], None if i % 5 == 0 else i % 3) for i in range(90)]
    rows += [(90, None, 1), (91, [1.0, None, 2.0, 3.0], 1), (92, [1.0, float("nan"), 2.0, 3.0], 1), (93, [1.0, float("inf"), 2.0, 3.0], None), (None, [0.5, 0.25, -0.001, 0.0], None), (None, [0.5, 0.25, -0.001, 0.0], 2)]
    return [(*r, "c", 1, 2, 3) for r in rows]


@pytest.mark.parametrize("most", [100_000, 0])
def test_odd_rows(spark, monkeypatch, most):
    monkeypatch.setattr(codes, "MOST_BROADCAST", most)
    rows = odd_rows()
    table = spark.createDataFrame(rows, ODD).repartition(5)
    assert got(codes.compress(table, parts=2, entries=8)) == brute([(r[0], r[2], r[1]) for r in rows], 2, 8, 2)
    few = spark.createDataFrame(rows[:3], ODD)
    assert got(codes.compress(few, parts=2)) == brute([(r[0], r[2], r[1]) for r in rows[:3]], 2, 64, 2)


def test_empty_and_impossible_tables(spark):
    none = spark.createDataFrame([], ODD)
    assert codes.compress(none).collect() == [] and codes.compress(none).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0] * 5, 1)], "vec_id long, embedding array<float>, label int"), parts=2)
    mixed = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [1.0, 2.0, 3.0, 4.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [r["vec_id"] for r in codes.compress(mixed, parts=2).collect()] == [1]


def test_codes_stand_for_near_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = codes.usable(table)
    width = len(table.first()["embedding"])
    books = codes.fitted(rows, width)
    back = {r["vec_id"]: np.array(r["vector"]) for r in codes.restored(codes.coded(rows, books, width), books).collect()}
    error = [np.square(back[r["vec_id"]] - r["embedding"]).mean() for r in table.collect()]
    assert np.mean(error) < 0.25 * np.var([r["embedding"] for r in table.collect()])
