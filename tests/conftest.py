"""One local session for all tests, and the comparison with DuckDB."""

import os
import tempfile

import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    conf = {
        "spark.master": "local[8]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC", "spark.local.dir": folder, "spark.checkpoint.dir": f"{folder}/checkpoints", "spark.sql.warehouse.dir": f"{folder}/warehouse",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sql, folder=DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def comparable(names, rows):
    """Columns by name, rows in order, floats to nine significant digits."""
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        return float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x

    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def same(df, sql, folder=DATA):
    got = comparable(df.columns, [tuple(r) for r in df.collect()])
    want = comparable(*duck(sql, folder))
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        assert len(a) == len(b)
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= max(1e-7 * abs(y), 1e-9) or x == y or x != x and y != y, (a, b)
            else:
                assert x == y, (a, b)
