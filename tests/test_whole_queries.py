"""Queries that answer for the whole mesh, against plain code and at a size where a subset would show."""

import duckdb

from trilattice.model import from_rows, lattice
from trilattice.operators import topology as P
from trilattice.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def near_brute(elements, k=2):
    out = {}
    for seed in range(len(elements)):
        ring = {seed}
        for _ in range(k):
            nodes = {n for e in ring for n in elements[e]}
            ring = {e for e, ns in enumerate(elements) if nodes & set(ns)}
        out[seed] = ring
    return out


def test_k_ring_of_every_element(spark):
    n = 6
    elements = [t for j in range(n) for i in range(n) for k in [j * (n + 1) + i] for t in ((k, k + 1, k + n + 2), (k, k + n + 2, k + n + 1)) if (i + j) % 5]
    m = from_rows(spark, [(i, j, 1) for j in range(n + 1) for i in range(n + 1)], elements)
    got = {}
    for r in P.k_ring(m, m.elements, 2).collect():
        got.setdefault(r.seed, set()).add(r.elem_id)
    assert got == near_brute(elements)


def test_kring_has_a_row_for_each_element(spark):
    elements = lattice(spark, SF).elements.select("elem_id")
    whole = {r.elem_id: r.near for r in QUERIES["kring"](spark, SF).collect()}
    assert whole.keys() == {r.elem_id for r in elements.collect()}


def test_raster_sample_has_a_row_for_each_node(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    whole = {r.node_id: r.depth for r in QUERIES["raster_sample"](spark, SF).collect()}
    want = dict(duck.sql(ORACLES["raster_sample"]).fetchall())
    assert whole.keys() == want.keys() == {r.node_id for r in lattice(spark, SF).nodes.select("node_id").collect()}
    assert all(abs(whole[n] - d) <= 2e-6 for n, d in want.items())
    assert sum(d > 0 for n, d in whole.items() if n >= 5000) > 1000
