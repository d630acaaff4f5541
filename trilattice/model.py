"""A mesh as three relations.

nodes(mesh_id, node_id, x, y, depth), elements(mesh_id, elem_id, n0, n1, n2) and boundary(mesh_id, kind, seg_id,
ibtype, pos, node_id). Ids are columns, never row positions; any number of meshes share the tables, and every
operator groups and joins within mesh_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODES = "mesh_id string, node_id long, x double, y double, depth double"
ELEMENTS = "mesh_id string, elem_id long, n0 long, n1 long, n2 long"
BOUNDARY = "mesh_id string, kind string, seg_id int, ibtype int, pos int, node_id long"


@dataclass
class Mesh:
    nodes: DataFrame
    elements: DataFrame
    boundary: DataFrame

    @property
    def open(self) -> DataFrame:
        return self.boundary.where("kind = 'open'")

    @property
    def land(self) -> DataFrame:
        return self.boundary.where("kind = 'land'")

    def with_(self, **changes: DataFrame) -> "Mesh":
        return Mesh(**({"nodes": self.nodes, "elements": self.elements, "boundary": self.boundary} | changes))


def from_rows(spark: SparkSession, nodes: list, elements: list, open_: list = (), land: list = (), mesh_id: str = "m") -> Mesh:
    """A mesh of plain lists: (x, y, depth), (n0, n1, n2), open segments of ids, land segments (ibtype, ids). Row positions become ids."""
    b = [(mesh_id, "open", s, None, p, n) for s, seg in enumerate(open_) for p, n in enumerate(seg)]
    b += [(mesh_id, "land", s, t, p, n) for s, (t, seg) in enumerate(land) for p, n in enumerate(seg)]
    return Mesh(
        spark.createDataFrame([(mesh_id, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(nodes)], NODES),
        spark.createDataFrame([(mesh_id, i, *map(int, e)) for i, e in enumerate(elements)], ELEMENTS),
        spark.createDataFrame(b, BOUNDARY),
    )


#: Columns of the lattice; every 97th customer's lower triangle is turned over. Parameters of the derived mesh.
COLUMNS, TURNED = 50, 97


def lattice(spark: SparkSession, sf_dir: str) -> Mesh:
    """The mesh that the orders table stands for: a node per order on a jittered lattice, two triangles per kept cell.

    The bottom row is the open boundary; the right column, the top row from the right and the left column downward are land.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c, w = F.col("o_orderkey"), F.col("o_custkey"), COLUMNS
    name = F.lit("lattice").alias("mesh_id")
    nodes = orders.select(name, k.alias("node_id"), (k % w + F.lit(0.004) * (c % 100)).alias("x"), (F.floor(k / w) + F.lit(0.004) * ((c * 7) % 100)).alias("y"), (F.col("o_totalprice") / 10000).alias("depth"))
    top = orders.agg(F.max("o_orderkey")).first()[0]
    cells = orders.where((k % w < w - 1) & (k + w <= top) & (F.col("o_orderstatus") != "P"))
    turned = c % TURNED == 0
    lower = F.struct((2 * k).alias("elem_id"), k.alias("n0"), F.when(turned, k + w + 1).otherwise(k + 1).alias("n1"), F.when(turned, k + 1).otherwise(k + w + 1).alias("n2"))
    upper = F.struct((2 * k + 1).alias("elem_id"), k.alias("n0"), (k + w + 1).alias("n1"), (k + w).alias("n2"))
    elements = cells.select(name, F.inline(F.array(lower, upper)))
    last = (top // w) * w

    def side(kind: str, seg: int, where, pos):
        return orders.where(where).select(name, F.lit(kind).alias("kind"), F.lit(seg).alias("seg_id"), F.lit(None if kind == "open" else 0).cast("int").alias("ibtype"), pos.cast("int").alias("pos"), k.alias("node_id"))

    boundary = side("open", 0, k < w, k).unionByName(side("land", 0, k % w == w - 1, F.floor(k / w))).unionByName(side("land", 1, k >= last, top - k)).unionByName(side("land", 2, k % w == 0, F.floor((top - k) / w)))
    return Mesh(nodes, elements, boundary)


#: The same mesh for DuckDB, and what most oracles build on.
LATTICE_SQL = """
WITH RECURSIVE nodes AS (SELECT o_orderkey AS node_id, o_orderkey % 50 + 0.004::DOUBLE * (o_custkey % 100) AS x, (o_orderkey // 50) + 0.004::DOUBLE * ((o_custkey * 7) % 100) AS y, o_totalprice / 10000 AS depth FROM orders),
top AS (SELECT max(o_orderkey) AS top FROM orders),
cells AS (SELECT o_orderkey AS k, o_custkey % 97 = 0 AS turned FROM orders, top WHERE o_orderkey % 50 < 49 AND o_orderkey + 50 <= top AND o_orderstatus <> 'P'),
elements AS (SELECT 2 * k AS elem_id, k AS n0, CASE WHEN turned THEN k + 51 ELSE k + 1 END AS n1, CASE WHEN turned THEN k + 1 ELSE k + 51 END AS n2 FROM cells
  UNION ALL SELECT 2 * k + 1, k, k + 51, k + 50 FROM cells),
boundary AS (SELECT 'open' AS kind, 0 AS seg_id, o_orderkey AS pos, o_orderkey AS node_id FROM orders WHERE o_orderkey < 50
  UNION ALL SELECT 'land', 0, o_orderkey // 50, o_orderkey FROM orders WHERE o_orderkey % 50 = 49
  UNION ALL SELECT 'land', 1, top - o_orderkey, o_orderkey FROM orders, top WHERE o_orderkey >= top // 50 * 50
  UNION ALL SELECT 'land', 2, (top - o_orderkey) // 50, o_orderkey FROM orders, top WHERE o_orderkey % 50 = 0),
opened AS (SELECT * FROM boundary WHERE kind = 'open'),
tri AS (SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2, a.depth AS d0, b.depth AS d1, c.depth AS d2
  FROM elements e JOIN nodes a ON a.node_id = n0 JOIN nodes b ON b.node_id = n1 JOIN nodes c ON c.node_id = n2),
len AS (SELECT *, ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0)) / 2 AS area, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS l01, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS l12, sqrt((x0 - x2) * (x0 - x2) + (y0 - y2) * (y0 - y2)) AS l20 FROM tri),
cosines AS (SELECT *, CASE WHEN l20 * l01 > 0 THEN (l20 * l20 + l01 * l01 - l12 * l12) / (2 * l20 * l01) ELSE 1 END AS c0, CASE WHEN l01 * l12 > 0 THEN (l01 * l01 + l12 * l12 - l20 * l20) / (2 * l01 * l12) ELSE 1 END AS c1,
  CASE WHEN l12 * l20 > 0 THEN (l12 * l12 + l20 * l20 - l01 * l01) / (2 * l12 * l20) ELSE 1 END AS c2 FROM len),
geo AS (SELECT *, degrees(acos(greatest(-1, least(1, c0)))) AS a0, degrees(acos(greatest(-1, least(1, c1)))) AS a1, degrees(acos(greatest(-1, least(1, c2)))) AS a2, 4 * sqrt(3.0::DOUBLE) * abs(area) / (l01 * l01 + l12 * l12 + l20 * l20) AS alpha FROM cosines),
half AS (SELECT elem_id, least(n0, n1) AS u, greatest(n0, n1) AS v FROM elements UNION ALL SELECT elem_id, least(n1, n2), greatest(n1, n2) FROM elements UNION ALL SELECT elem_id, least(n2, n0), greatest(n2, n0) FROM elements),
edges AS (SELECT u, v, count(*) AS uses, min(elem_id) AS first_elem, max(elem_id) AS last_elem FROM half GROUP BY u, v),
rim AS (SELECT u, v FROM edges WHERE uses = 1),
rim_nodes AS (SELECT u AS node_id FROM rim UNION SELECT v FROM rim),
inner_edges AS (SELECT * FROM edges WHERE uses = 2),
dual AS (SELECT first_elem AS a, last_elem AS b FROM inner_edges UNION ALL SELECT last_elem, first_elem FROM inner_edges),
corner AS (SELECT elem_id, n0 AS node_id FROM elements UNION ALL SELECT elem_id, n1 FROM elements UNION ALL SELECT elem_id, n2 FROM elements),
valence AS (SELECT n.node_id, count(c.elem_id) AS valence FROM nodes n LEFT JOIN corner c USING (node_id) GROUP BY n.node_id),
open_nodes AS (SELECT DISTINCT node_id FROM opened),
listed AS (SELECT DISTINCT node_id FROM boundary),
marks AS (SELECT n.node_id, CASE WHEN o.node_id IS NOT NULL THEN 2 WHEN r.node_id IS NOT NULL THEN 1 ELSE 0 END AS mark FROM nodes n LEFT JOIN open_nodes o USING (node_id) LEFT JOIN rim_nodes r USING (node_id)),
mark_sums AS (SELECT elem_id, sum(mark) AS total FROM corner JOIN marks USING (node_id) GROUP BY elem_id),
open_edges AS (SELECT u, v FROM rim WHERE u IN (FROM open_nodes) AND v IN (FROM open_nodes)),
both_ways AS (SELECT u AS node_id, v AS other FROM edges UNION ALL SELECT v, u FROM edges),
cc(elem_id, label) USING KEY (elem_id) AS (SELECT elem_id, elem_id FROM elements UNION SELECT d.b, min(c.label) FROM cc c JOIN dual d ON d.a = c.elem_id JOIN recurring.cc o ON o.elem_id = d.b WHERE c.label < o.label GROUP BY d.b),
sizes AS (SELECT label, count(*) AS size FROM cc GROUP BY label),
tangents AS (SELECT seg_id, pos, b.node_id, x, y, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ty FROM opened b JOIN nodes USING (node_id) WINDOW w AS (PARTITION BY seg_id ORDER BY pos)),
unit AS (SELECT *, sqrt(tx * tx + ty * ty) AS tn FROM tangents),
spokes AS (SELECT t.seg_id, t.node_id, e.other, p.x - t.x AS ex, p.y - t.y AS ey, CASE WHEN tn > 0 THEN tx / tn ELSE 0 END AS ux, CASE WHEN tn > 0 THEN ty / tn ELSE 0 END AS uy, t.x AS bx, t.y AS "by"
  FROM unit t JOIN both_ways e USING (node_id) JOIN nodes p ON p.node_id = e.other WHERE NOT EXISTS (SELECT 1 FROM opened s WHERE s.seg_id = t.seg_id AND s.node_id = e.other)),
deviations AS (SELECT *, 90 - degrees(acos(least(1, greatest(0, abs(ex * ux + ey * uy) / CASE WHEN ex * ex + ey * ey > 0 THEN sqrt(ex * ex + ey * ey) ELSE 1 END)))) AS dev FROM spokes)
"""
