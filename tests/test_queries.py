"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from corpuslens.plans.registry import ORACLES, QUERIES, query

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, con):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        assert sorted(rel.columns) == cols
        want = sorted((tuple(norm(v) for _, v in sorted(zip(rel.columns, row, strict=True))) for row in rel.fetchall()), key=str)
        assert got == want


def test_names_are_registered_once():
    assert {"document_page", "document_list_page"} <= set(QUERIES) and "place" in ORACLES["document_page"]

    def document_page(spark, sf_dir):
        return None

    with pytest.raises(ValueError):
        query()(document_page)
    assert QUERIES["document_page"] is not document_page
