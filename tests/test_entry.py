"""All queries run at the smallest size, and agree with their SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__
from corpusloom.plans import file_queries, queries, site_queries, stored_queries

MODULES = [queries, site_queries, file_queries, stored_queries]
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, list | np.ndarray):
        return str([plain(v) for v in value])
    if isinstance(value, float):
        return "null" if value != value else f"{value:.9g}"
    return "null" if value is None or str(value) == "<NA>" else str(value)


def table(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and table(got) == table(want)
    assert len(got) > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_links_come_from_all_paragraphs(spark):
    got = QUERIES["link_recommendations"](spark, DATA).toPandas()
    assert got["paragraph_index"].max() > 0 and got.groupby("source").size().max() > 1
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.text.split()[0] in texts[r.source].split("\n")[r.paragraph_index] for r in got.itertuples())


def test_texts_are_whole(spark):
    from corpusloom.functions.slugs import fold

    rows = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert {r.doc_id: r.slug for r in QUERIES["slugs"](spark, DATA).collect()} == {r.doc_id: fold(r.text, r.lang, 80) for r in rows}
    got = {r.doc_id: r.escaped for r in QUERIES["escaped_text"](spark, DATA).collect()}
    assert all(len(got[r.doc_id]) >= len(r.text) for r in rows) and max(map(len, got.values())) > 2000
