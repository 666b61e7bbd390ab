"""Every query with SQL gives the rows that DuckDB gives; the others run."""

import datetime
import decimal

import duckdb
import pytest

from millrace import catalogue, catalogue_annotated, catalogue_questions  # noqa: F401  the latter two add their queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, sf_dir, duck):
    frame = catalogue.QUERIES[name](spark, sf_dir)
    found = frame.collect()
    if name in catalogue.SQL:
        result = duck.execute(catalogue.SQL[name])
        columns = [x[0] for x in result.description]
        assert sorted(columns) == sorted(frame.columns)
        assert rows(found, frame.columns) == rows(result.fetchall(), columns)
    else:
        assert found


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
