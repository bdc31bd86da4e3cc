"""Every query of the library against DuckDB on the smallest fixture tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from folium import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no fixture tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, FOLDER).toArrow()
    assert got.num_rows
    if name in queries.SQL:
        cursor = duck.execute(queries.SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(got.schema.names)
        rows = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in cursor.fetchall())
        assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in got.to_pylist()) == rows


def test_case_file_of_several_lists(spark, tmp_path):
    """Lists that one task writes are files of their own."""
    rows = [(i, f"w{i} x y") for i in range(430)]
    spark.createDataFrame(rows, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = queries.QUERIES["case_file"](spark, str(tmp_path)).select("name", "question").collect()
    assert sorted(map(tuple, got)) == sorted((str(i), t) for i, t in rows)
