from collections import Counter

import duckdb

from waymark.llm import mixing
from waymark.llm.queries import op5_mix_sources


def oracle(table, plan):
    con = duckdb.connect()
    con.register("documents", table)
    return Counter(tuple(r) for r in con.execute(mixing.oracle_sql(plan)).fetchall())


PLANS = (mixing.Plan(), mixing.Plan(percent=150, max_epochs=3), mixing.Plan(domain={"web": 0, "books": 1}, percent=90), mixing.Plan(percent=0))


def test_against_sql(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd):
        for plan in PLANS:
            assert Counter(map(tuple, mixing.mixture(df, plan).collect())) == oracle(df.select("doc_id", "text", "lang", "source").toArrow(), plan)


def test_shortages_go_to_siblings_before_ancestors(spark):
    leaves = [("web", "en", "a", 100), ("web", "en", "b", 10_000), ("web", "de", "c", 10_000), ("books", "en", "d", 10_000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, avail long")
    plan = mixing.Plan(domain={"web": 1, "books": 1}, lang={"en": 1, "de": 1}, percent=20, max_epochs=1)
    got = {r["source"]: r["got"] for r in mixing.leaf_budgets(df, plan).collect()}
    # 6020 tokens: 3010 to each domain, 1505 to each language of web; a gives its 100, b makes up for it
    assert got == {"a": 100, "b": 1405, "c": 1505, "d": 3010}


def test_rows_and_columns_stay(odd):
    mixed = mixing.mix(odd, mixing.Plan(percent=200, max_epochs=2))
    assert mixed.columns == odd.columns
    assert Counter(map(str, mixed.collect())) == Counter({k: 2 * v for k, v in Counter(map(str, odd.collect())).items()})


def test_mix_is_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == Counter(r["doc_id"] for r in op5_mix_sources(spark, sf).collect())


def test_empty(none):
    assert mixing.mixture(none).collect() == [] and mixing.mix(none).collect() == []
