import glob
import math

import duckdb
import pytest

import __spark_entry__
from waymark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalog.ORACLES:
        assert rows
        return
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=str)
    assert rows == want


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).columns == ["v", "dist"]
    assert set(catalog.ORACLES) <= set(__spark_entry__.oracle_sql()) and set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_nothing_else_imports_the_optional_package():
    root = __spark_entry__.__file__.rsplit("/", 1)[0]
    for path in glob.glob(f"{root}/waymark/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "waymark.llm" not in open(path).read()
