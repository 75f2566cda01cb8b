import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from waymark.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def runs(text, orders):
    words = WORD.findall(lower(text))
    return [" ".join(words[i : i + n]) for n in range(1, orders + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, orders=1, percent=10, buckets=10_000):
    """resample() of (doc_id, text) pairs, one feature after the other."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in runs(text, orders)) for texts in ([x for _, x in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets))))
    rows = []
    for doc_id, text in docs:
        found = runs(text, orders)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(runs(text, 1))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("orders", [1, 3])
def test_against_brute_force(spark, sf, texts, orders):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet").limit(200), spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs, wanted = [(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()]
    found = resampling.resample(spark.createDataFrame(pairs, "doc_id long, text string"), target, orders=orders)
    assert sorted(map(tuple, found.collect()), key=str) == brute(pairs, wanted, orders)


def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = resampling.resample(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(con.execute(resampling.oracle_sql()).fetchall(), key=str)


@pytest.mark.parametrize("orders", [1, 2])
def test_odd_rows(spark, odd, none, orders):
    target = spark.createDataFrame([(1, "fox jumps", 2), (2, None, 3), (3, "", 4), (3, "zeta eta", 5)], "item_id long, text string, bucket int")
    pairs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = sorted(map(tuple, resampling.resample(odd, target, percent=60, least_words=3, orders=orders).collect()), key=str)
    assert len(found) == len(pairs)
    ranks = sorted(r[4] for r in found if r[4] is not None)
    able = sum(len(runs(t, 1)) >= 3 for _, t in pairs)
    assert ranks == list(range(1, 60 * able // 100 + 1))
    assert [r[:4] for r in found] == [r[:4] for r in brute(pairs, ["fox jumps", "", "", "zeta eta"], orders)]
    assert resampling.resample(none, target).collect() == []
    nothing = target.limit(0)
    assert [r[:4] for r in sorted(map(tuple, resampling.resample(odd, nothing, orders=orders).collect()), key=str)] == [r[:4] for r in brute(pairs, [], orders)]


def test_ties_go_to_the_smaller_id_and_the_like_are_drawn(spark):
    like, other = "alpha beta gamma delta " * 6, "kilo lima mike november " * 6
    docs = spark.createDataFrame([(i, like if i % 10 == 0 else other) for i in range(400)], "doc_id long, text string")
    found = resampling.resample(docs, spark.createDataFrame([(like,)], "text string")).collect()
    drawn = [r["doc_id"] for r in found if r["rank"]]
    assert len(drawn) == 40 and all(i % 10 == 0 for i in drawn)
    same = spark.createDataFrame([(7, other)] * 30, "doc_id long, text string")
    assert sorted(r["rank"] for r in resampling.resample(same, docs).collect() if r["rank"]) == [1, 2, 3]


def test_no_word_is_exchanged_for_single_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gains = spark.range(10_000).selectExpr("cast(id as int) bucket", "id gain")
    plan = resampling.weights(docs, gains)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "SortMergeJoin" not in plan
