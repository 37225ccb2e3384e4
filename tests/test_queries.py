"""Every core query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from vexmark import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = Q.QUERIES[name](spark, sf)
    want = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(cell(r[c]) for c in order) for r in got.collect())
    at = [names.index(c) for c in order]
    b = sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert Q.QUERIES[name](spark, sf).count() > 0


def test_payload_checksums(spark, sf):
    import struct
    import zlib

    rows = Q.payload_crc32(spark, sf).collect()
    vectors = {r.id: r.embedding for r in Q.vectors(spark, sf).collect()}
    assert all(r.payload_crc == zlib.crc32(struct.pack("<64f", *vectors[r.id])) and r.payload_length == 256 for r in rows)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
