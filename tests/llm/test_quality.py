import math
import zlib

import numpy as np

from waymark.llm import quality


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    forest = quality.fit(x[:1500], y[:1500], trees=40)
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    one = []
    for row in x[:20]:  # node by node
        out = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            out += v[node - len(f)]
        one.append(out)
    assert np.allclose(forest.raw(x[:20]), one)


def test_held_out_quality(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    good = [r for r in held if r["quality"] == 1]
    assert np.mean([r["predicted"] for r in good]) > 0.97


def test_odd_rows(spark, sf, odd, none):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    nothing = spark.createDataFrame([], labels.schema)
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(none, labels).collect() == []
    kept = quality.keep(odd, labels)
    assert kept.columns == odd.columns and {str(r) for r in kept.collect()} <= {str(r) for r in odd.collect()}


def test_held_out_labels_are_not_used(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = labels.withColumn("quality", F.when(quality.fold_of(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.score(docs, labels).collect()) == sorted(quality.score(docs, other).collect())


def plain_statistics(text):
    """The statistics in their plainest form, one by one."""
    raw, words, lines = text.encode(), text.split(), [x for x in text.split("\n") if x.strip()]
    size, n, m = max(1, len(raw)), max(1, len(words)), max(1, len(lines))
    pairs, kinds = list(zip(words, words[1:])), set(words)
    share = lambda test: sum(map(test, raw)) / size
    letters = set(range(97, 123)) | set(range(65, 91)) | set(range(48, 58))
    marks = set(b".,;:?'-")
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / len(lengths)
    return {
        "log_chars": math.log(1 + len(text)), "log_words": math.log(1 + len(words)), "mean_word": mean, "std_word": math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths)),
        "share_upper": share(lambda b: 65 <= b <= 90), "share_digit": share(lambda b: 48 <= b <= 57), "share_space": share(lambda b: b in (9, 32)), "share_newline": share(lambda b: 10 <= b <= 13),
        "share_symbol": share(lambda b: 33 <= b < 127 and b not in letters and b not in marks), "share_stop": share(lambda b: b in marks), "share_pipe": raw.count(b"|") / size, "share_bang": raw.count(b"!") / size, "share_nonascii": share(lambda b: b > 127),
        "distinct_words": len(kinds) / n, "repeated_next": sum(a == b for a, b in pairs) / n, "top_word": max((words.count(w) for w in kinds), default=0) / n, "upper_words": sum(w.isupper() for w in words) / n,
        "symbol_words": sum(any(w[i] in "#$%&*|!" and w[i + 1] in "#$%&*|!" for i in range(len(w) - 1)) for w in kinds) / max(1, len(kinds)), "distinct_lines": len(set(lines)) / m, "top_line_share": max((lines.count(x) for x in lines), default=0) / m,
        "mean_line": math.log(1 + len(text) / m), "short_lines": sum(len(x) < 20 for x in lines) / m, "stopped_lines": sum(x.rstrip()[-1] in ".!?" for x in lines) / m, "distinct_pairs": len(set(pairs)) / max(1, len(pairs)),
        "compressed": sum(len(zlib.compress(raw[i : i + quality.PIECE], 1)) for i in range(0, len(raw), quality.PIECE)) / size, "longest_word": math.log(1 + max(lengths)), "capital_words": sum(w.istitle() for w in kinds) / max(1, len(kinds)),
    }


def test_the_whole_query_against_brute_force(spark, sf, odd):
    """Every statistic, and every score node by node, for the table and the odd rows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    forest = quality.train(docs, labels)
    short = odd.filter("doc_id is null or doc_id <> 11").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").unionByName(short).collect()]
    want = []
    for doc_id, text in rows:
        x = plain_statistics(text)
        assert np.allclose(quality.statistics_of(text), [x[s] for s in quality.STATISTICS])
        x, total = quality.statistics_of(text), forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[f[node]] > t[node])
            total += v[node - len(f)]
        want.append((str(doc_id), 1 / (1 + math.exp(-total))))
    got = [(str(r["doc_id"]), r["score"]) for r in quality.score(docs, labels).collect()]
    table = len(got)
    assert np.allclose([s for _, s in sorted(want[:table])], [s for _, s in sorted(got)])


def test_several_texts_and_labels_of_one_document(spark, sf):
    """The fit is the same in any order of rows."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    more = docs.unionByName(docs.selectExpr("doc_id", "concat(text, ' and more') as text"))
    both = labels.unionByName(labels.selectExpr("doc_id", "1 - quality as quality", "toxic").limit(5))
    first, second = (quality.train(d.repartition(n), both) for d, n in ((more, 2), (more.orderBy("text"), 5)))
    assert (first.threshold == second.threshold).all() and (first.value == second.value).all()
