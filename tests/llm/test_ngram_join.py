from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from waymark.llm import ngram_join
from waymark.llm.components import components


def brute(rows):
    """For each row: least doc_id of its class and number of linked rows; rows keep their places."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both * 5 >= 4 * (len(sets[i]) + len(sets[j]) - both)):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups[find(i)] = min(doc_id, groups.get(find(i), doc_id))
    return Counter((d, groups.get(find(i)), links[i]) for i, (d, _) in enumerate(rows))


def compare(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(df).collect())
    assert got == brute(rows)


def near_copies(n, words=150, seed=2):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    out = []
    for i in range(n):
        text = list(base)
        for at in rng.integers(0, words, int(rng.integers(0, 7))):
            text[at] = f"x{rng.integers(0, 50)}"
        out.append((i, " ".join(text)))
    return out


def test_against_brute_force(spark, texts):
    compare(spark.createDataFrame(texts, "doc_id long, text string"))


def test_a_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    compare(spark.createDataFrame(near_copies(120), "doc_id long, text string"))


def test_odd_rows(odd, none):
    compare(odd.select("doc_id", F.when(F.length("text") < 10_000, F.col("text")).alias("text")))
    assert ngram_join.join(none).collect() == [] and ngram_join.keep_one(none).collect() == []


def test_one_stays_of_each_group(spark, odd, texts):
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert set(ids.values()) == {1} and 1 in ids and 2 not in ids and 6 in ids and 7 not in ids and 10 in ids and 3 in ids and 4 not in ids
    df = spark.createDataFrame(texts, "doc_id long, text string")
    classes = {r["class_id"] for r in ngram_join.join(df).collect()}
    assert sorted(r["doc_id"] for r in ngram_join.keep_one(df).collect()) == sorted(classes)


def test_one_stays_where_ids_are_null_or_shared(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (None, text(2)), (5, text(3)), (5, text(4)), (5, text(4)), (6, text(1)), (7, text(3) + " end"), (8, None), (8, "")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = Counter((r["doc_id"], r["text"] or "") for r in ngram_join.keep_one(df).collect())
    assert kept == Counter([(None, text(0)), (6, text(1)), (None, text(2)), (5, text(3)), (5, text(4)), (8, "")])


def test_prefixes_shorten_until_the_measured_recall():
    none, many = np.zeros(ngram_join.SIMILARITIES, np.int64), np.zeros(ngram_join.SIMILARITIES, np.int64)
    many[-1] = 10**6
    # without links only the threshold's own chance counts
    assert [ngram_join.measured_recall(none, d) >= ngram_join.RECALL for d in (6, 5, 4)] == [False, False, True]
    assert ngram_join.measured_recall(many, 6) >= ngram_join.RECALL
    assert np.isclose(ngram_join.measured_recall(none, 5), 1 - (1 - 0.8**5) ** ngram_join.TREES)


def test_labels_hold_minhash_values_in_order():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 300, np.uint64))
    high, low = ngram_join.labels(values)
    for tree in (0, 7, 15):
        for level in range(ngram_join.DEEPEST):
            at = level * ngram_join.TREES + tree
            least = min((int(v) ^ int(ngram_join.XORS[at])) * int(ngram_join.ODDS[at]) % 2**64 for v in values)
            word = int((high, low)[level // 4][tree]) >> (16 * (3 - level % 4)) & 0xFFFF
            assert word == int(ngram_join.mixed(np.array([least], np.uint64))[0]) >> 48


def test_links_between_merging_clusters(spark, monkeypatch):
    """Links of all similarities, found over several lengths of prefixes."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    compare(spark.createDataFrame([(g * 1000 + i, t) for g in range(6) for i, t in near_copies(14, 90, seed=g)], "doc_id long, text string"))


def test_all_ids_null(spark):
    rows = [(None, t) for _, t in near_copies(30, 80)] + [(None, "one"), (None, "one"), (None, None)]
    compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}
