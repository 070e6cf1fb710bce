"""Every query against its SQL over the smallest tables, and the same result with another number of partitions."""

from __future__ import annotations

import math
import os

import pytest

import __spark_entry__ as entry
from assetlode import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(map(plain, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    sql = catalog.oracle_sql()[name]
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())


@pytest.mark.parametrize("name", ["exact_duplicates", "perceptual_groups", "sort_inventory_size", "paginate_groups", "cache_gc"])
def test_partitions_do_not_matter(spark, name):
    rows = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, catalog.queries()[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert rows[0] == rows[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
