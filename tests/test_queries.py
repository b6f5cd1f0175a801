"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from callscope.plans import registry

BASE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    con = duckdb.connect()
    for t in TABLES:
        p = Path(BASE, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def rows(frame):
    def text(v):
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, BASE).toPandas(), duck.execute(registry.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_all_readability_columns(spark):
    r = registry.QUERIES["readability_all"](spark, BASE)
    assert {"text_standard", "dale_chall_readability_score", "difficult_words", "linsear_write_formula"} <= set(r.columns)
    assert r.where("text_standard is not null").count() == r.count()
