import numpy as np

from waymark.llm import ann


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        score = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, score)) if ids[j] != ids[i]][:k]
        out[ids[i]] = [(ids[j], score[j]) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.astype(np.float32).tolist(), 1, "p") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, label int, part string")


def search(df):
    out = {}
    for r in sorted(ann.search(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_PART", 400)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 5000)] + 0.4 * rng.normal(size=(5000, 24))).astype(np.float32).astype(float)
    x[2000:3500] = x[77]  # one common vector
    ids = np.arange(5000)
    want, got = brute(ids, x, 10), search(frame(spark, ids, x))
    assert want.keys() == got.keys()
    scores = [np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) or len(set(got[q]) & set(want[q])) / 10 for q in want]
    assert np.mean(scores) >= 0.9
    for q in got:
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) and q not in dict(got[q])
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-12 for v, s in got[q])
    alike = next(q for q in want if 2000 <= q < 3500)
    assert [v for v, _ in got[alike]] == [v for v, _ in want[alike]]


def test_parts_inside_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_A_PART", 100)
    monkeypatch.setattr(ann, "MOST_PARTS", 10)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 8)
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(60, 16))[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 16))).astype(np.float32).astype(float)
    x[1000:1500] = x[5]
    ids = np.arange(6000)
    want, got = brute(ids, x, 10), search(frame(spark, ids, x))
    assert want.keys() == got.keys()
    assert np.mean([np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) or len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_every_row_twelve_times_and_clashing_columns(spark):
    """Recall over the table's own queries, each row twelve times, with columns named like the operator's own."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 12)).astype(np.float32).astype(float)
    ids = np.arange(900)
    df = frame(spark, ids.repeat(12), x.repeat(12, axis=0)).selectExpr("*", "1 as leaf", "2 as block", "3 as round", "'q' as query_id", "0.5 as score", "7 as rank", "vec_id as parts", "embedding as vector")
    want, got = brute(ids, x, 10), search(df)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9
    assert all(len(got[q]) == 10 for q in want)


def test_repeated_rows(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 8)), 3).astype(np.float32).astype(float)
    ids = np.arange(60) * 50
    want = brute(ids, x, 10)
    assert search(frame(spark, ids.repeat(2), x.repeat(2, axis=0))) == search(frame(spark, ids, x))
    # ten of each, and a second, far vector for every id
    many, far = frame(spark, ids.repeat(10), x.repeat(10, axis=0)), frame(spark, ids[ids % 100 != 0], x[ids % 100 != 0] + 50)
    got = search(many.unionByName(far))
    assert {q: [v for v, _ in n] for q, n in got.items()} == {q: [v for v, _ in n] for q, n in want.items()}


def test_block_counts_each_id_once():
    import pandas as pd

    x = np.arange(1, 41, dtype=float)[:, None] * [1.0, 0.5]
    rows = pd.DataFrame({"vec_id": np.arange(40).repeat(5), "vector": [v for v in x for _ in range(5)]})
    near = ann.rank_block(pd.DataFrame({"query_id": [0], "vector": [x[0]]}), rows, 10)
    assert near["vec_id"].tolist() == list(range(1, 11))


def test_few_and_odd_vectors(spark, none):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 0.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 2.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (100, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = search(df)
    assert [v for v, _ in got[0]] == [100, 1, 8] and [v for v, _ in got[100]] == [0, 1, 8]
    empty = spark.createDataFrame([], df.schema)
    assert search(empty) == {}
    assert search(df.filter("vec_id in (2, 3)")) == {}


def test_balanced_parts_cut_few_edges():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(8, 16)) * 3, 100, axis=0) + 0.2 * rng.normal(size=(800, 16))
    near = ann.nearest_in(x, x, 11)
    part = ann.cut_graph(x, near, 8, rng)
    assert np.bincount(part, minlength=8).max() <= np.ceil(1.1 * 100)
    assert (part[near] == part[:, None]).mean() > 0.8
