"""Values that lie on a line of a lattice, or that differ by rounding alone, fall as they do in SQL."""

import random
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from trilattice.model import from_rows
from trilattice.operators import references as N
from trilattice.operators import repair as R
from trilattice.operators import spatial as S
from trilattice.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    return con


def test_reference_boxes_of_nodes_on_lines(spark, duck):
    got = QUERIES["reference_boxes"](spark, SF)
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['reference_boxes']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_boxes_end_at_the_numbers_of_the_lattice(spark):
    """78.2 - 28 * 2.5 is 8.2, which doubles miss."""
    lattice = (3.2, 3.2, 53.2, 78.2, 2.5)
    rows = spark.range(30).select("id", N.reference_box(F.concat(F.lit("A"), F.col("id") + 1), *lattice).alias("b")).collect()
    assert all((r.b.xmin, r.b.ymax, r.b.ymin) == (3.2, round(78.2 - 2.5 * r.id, 1), round(75.7 - 2.5 * r.id, 1)) for r in rows)


def test_nearest_of_nodes_whole_turns_apart(spark, duck):
    """Nodes of one place on the sphere, by latitudes turns apart, differ by rounding alone; the nearest is SQL's."""
    nodes = duck.sql("SELECT i AS node_id, 10.2 + 0.02 * (i % 3) AS x, 5.14 + 360.0 * (i // 3) AS y FROM range(1500) t(i)").select("node_id, x::DOUBLE AS x, y::DOUBLE AS y")
    pts = [("a", 10.2, 5.1), ("b", 11.9, 4.7), ("c", -3.3, 20.2)]
    given = ", ".join(map(str, pts))
    want = duck.sql(
        f"""WITH n AS ({nodes.sql_query()}), pts(name, lon, lat) AS (SELECT name, lon::DOUBLE, lat::DOUBLE FROM (VALUES {given}) v(name, lon, lat)),
        h AS (SELECT name, node_id, 2 * 6371000 * asin(least(1, sqrt(pow(sin(radians(y - lat) / 2), 2) + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2)))) AS dist FROM pts, n)
        SELECT name, arg_min(node_id, dist) FROM h GROUP BY name"""
    ).fetchall()
    found = S.snap_to_nodes(spark.createDataFrame(pts, "name string, lon double, lat double"), spark.createDataFrame(nodes.fetchall(), "node_id long, x double, y double"))
    assert {r["name"]: r.node_id for r in found.collect()} == dict(want)


def test_means_of_neighbours_round_once_far_from_zero(spark):
    """Sums of ordinates of 180,000 round by the order of the rows, so that a node at the mean of its neighbours seemed to move."""
    rng = random.Random(1)
    nodes = [(i % 50 + 0.004 * rng.randrange(100), 180_000 + i // 50 + 0.004 * rng.randrange(100), 1.0) for i in range(1500)]
    elements = [e for k in range(1450) if k % 50 < 49 for e in ((k, k + 1, k + 51), (k, k + 51, k + 50))]
    near = {}
    for e in elements:
        for n in e:
            near.setdefault(n, set()).update(set(e) - {n})
    x, y = ({n: float(sum(Fraction(nodes[o][i]) for o in others) / len(others)) for n, others in near.items()} for i in range(2))
    found = {r.node_id: r for r in R.neighbour_means(from_rows(spark, nodes, elements)).collect()}
    assert found.keys() == near.keys() and all(abs(r.mx - x[n]) < 1e-13 for n, r in found.items())
    assert [n for n, r in found.items() if r.my != y[n]] == []


def test_elements_of_missing_nodes_are_not_judged(spark, tmp_path):
    """Order keys with a gap leave elements without one of their nodes; SQL has no shape for them, and each counted 9 before and after a move."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * REPLACE (o_orderkey + i * 20000 AS o_orderkey, 'O' AS o_orderstatus) FROM range(2) t(i), '{SF}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = QUERIES["smooth_candidates"](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['smooth_candidates']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
