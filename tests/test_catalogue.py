"""Every registered query of the engine gives its SQL twin's rows."""

import math
import os

import duckdb
import pytest

from keelson.plans import catalogue, texts  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels pages".split()


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    return None if value is None else str(value)


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, twin, name):
    frame = catalogue.QUERIES[name](spark, SF)
    want = twin.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert sorted_rows(frame.columns, frame.collect()) == sorted_rows(names, want.fetchall())
