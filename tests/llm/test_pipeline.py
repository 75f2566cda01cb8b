from collections import Counter

import corpus_pipeline
from waymark.llm import mixing, ngram_join, packing, quality, secrets


def test_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "one_of_each", "without_secrets", "mixed_sources", "packed"]
    good = {r["doc_id"] for r in quality.score(docs, labels).collect() if r["predicted"]}
    now = corpus_pipeline.good_quality(spark, docs, sf)
    assert {r["doc_id"] for r in now.collect()} == good and now.columns == docs.columns
    classes = {r["class_id"] for r in ngram_join.join(now).collect()}
    one = corpus_pipeline.one_of_each(spark, now, sf)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(classes)
    clean = corpus_pipeline.without_secrets(spark, one, sf)
    assert clean.count() == one.count() and secrets.digest(secrets.scan(clean, "doc_id")).filter("spans != ''").count() == 0
    mixed = corpus_pipeline.mixed_sources(spark, clean, sf)
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in mixing.mixture(clean).collect())
    key = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(packing.pack(mixed))


def test_odd_and_empty(spark, sf, odd, none):
    for start in (odd, none):
        docs = start
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = step(spark, docs, sf)
            assert docs.columns == start.columns
        corpus_pipeline.packed(spark, docs, sf).collect()
