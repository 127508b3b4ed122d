"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from graphloom.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        t = name.removesuffix(".parquet")
        path = f"{SF}/{name}/*.parquet" if os.path.isdir(f"{SF}/{name}") else f"{SF}/{name}"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(df):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "nan"):
            return "null"
        return repr(float(x)) if hasattr(x, "__float__") else str(x)

    return sorted(df.columns), sorted(tuple(map(value, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, oracle, name):
    assert plain(Q.QUERIES[name](spark, SF).toPandas()) == plain(oracle.sql(Q.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE_SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_images_of_every_zoom(spark):
    for name, deepest in (("edge_tile_images", 6), ("node_tile_images", 5)):
        found = Q.QUERIES[name](spark, SF).select("zoom").distinct().collect()
        assert {r["zoom"] for r in found} == set(range(deepest + 1))


@pytest.mark.parametrize("name", ["bfs_farthest", "shortest_paths"])
def test_ends_need_no_trees(spark, monkeypatch, name):
    """A row per start comes out of the search itself, not of a row per start and node."""
    monkeypatch.setattr(Q.paths, "bfs", None)
    assert Q.QUERIES[name](spark, SF).count() > 0
