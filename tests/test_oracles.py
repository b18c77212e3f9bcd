"""Every query with an oracle equals it on the smallest fixture; the others give rows."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: v for k, v in entry.queries().items() if not k.startswith("op") and k != "pipeline"}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def plain(value):
    """A value that both engines show alike."""
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return float(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in places]) for r in cursor.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["genre", "n_pos", "n_neg", "auroc", "threshold", "fpr", "recall"]
    assert df.count() > 0
