"""Nearest-neighbour, raster and cell-reference operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trilattice.functions import triangle as T
from trilattice.functions import units as U


def nearest_within(points: DataFrame, samples: DataFrame, radius: float, keys: list[str], group: list[str] = ()) -> DataFrame:
    """For each point (keys, x, y) the least distance to samples (sx, sy) of each group within the radius.

    Samples are bucketed in cells of the radius and each point looks in the nine cells around it; what is farther than the
    radius is left out rather than compared with everything.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    p = points.withColumn("__o", F.explode(around)).withColumns({"__i": cell("x") + F.col("__o.a"), "__j": cell("y") + F.col("__o.b")}).drop("__o")
    s = samples.withColumns({"__i": cell("sx"), "__j": cell("sy")})
    found = p.join(s, ["__i", "__j"]).withColumn("dist", T.distance((F.col("x"), F.col("y")), (F.col("sx"), F.col("sy")))).where(F.col("dist") <= radius)
    return found.groupBy(*keys, *group).agg(F.min("dist").alias("dist"))


def two_bank_width(centroids: DataFrame, samples: DataFrame, radius: float, keys: list[str], line: list[str]) -> DataFrame:
    """(keys, width): the two least distances to different boundary lines within the radius, summed; elements that see fewer than two lines are left out."""
    per_line = nearest_within(centroids, samples, radius, keys, line)
    order = Window.partitionBy(*keys).orderBy("dist", *line)
    two = per_line.withColumn("r", F.row_number().over(order)).where("r <= 2")
    return two.groupBy(*keys).agg(F.sum("dist").alias("width"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


def grade_sizes(lattice: DataFrame, points: DataFrame, size: float, grade: float, radius: float) -> DataFrame:
    """lattice (i, j, x, y, size) with size raised to max(size, t - grade * max(0, d - t), 0) at distance d of the nearest point."""
    near = nearest_within(lattice.select("i", "j", "x", "y"), points.select(F.col("x").alias("sx"), F.col("y").alias("sy")), radius, ["i", "j"])
    wanted = F.greatest(F.lit(size) - F.lit(grade) * F.greatest(F.lit(0.0), F.col("dist") - size), F.lit(0.0))
    return lattice.join(near, ["i", "j"], "left").withColumn("size", F.greatest("size", F.coalesce(wanted, F.lit(0.0)))).drop("dist")


def sample_raster(points: DataFrame, raster: DataFrame, affine: tuple[float, float, float, float], shape: tuple[int, int], keys: list[str], fill: float = 0.0, method: str = "linear") -> DataFrame:
    """(keys, depth) of points (x, y) in a raster (row, col, z) with (x0, y0, dx, dy) at its corner and (rows, columns).

    Bilinear between pixel centres, clamped at the edges; points outside, and those with a missing or NaN pixel, get
    `fill` as elevation. Elevation above zero is depth 0, below it its negative. One join of four exploded pixels.
    """
    (x0, y0, dx, dy), (rows, cols) = affine, shape
    p = points.withColumns({"__c": (F.col("x") - x0) / dx, "__r": (F.col("y") - y0) / dy})
    inside = (F.col("__c") >= 0) & (F.col("__c") <= cols) & (F.col("__r") >= 0) & (F.col("__r") <= rows)
    clamp = lambda c, top: F.least(F.greatest(c, F.lit(0)), F.lit(top)).cast("int")
    if method == "nearest":
        p = p.withColumns({"__c0": clamp(F.rint(F.col("__c") - 0.5), cols - 1), "__r0": clamp(F.rint(F.col("__r") - 0.5), rows - 1)})
        near = [(0, 0, F.lit(1.0))]
    else:
        p = p.withColumns({"__c0": clamp(F.floor(F.col("__c") - 0.5), cols - 2), "__r0": clamp(F.floor(F.col("__r") - 0.5), rows - 2)})
        unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
        p = p.withColumns({"__fc": unit(F.col("__c") - 0.5 - F.col("__c0")), "__fr": unit(F.col("__r") - 0.5 - F.col("__r0"))})
        near = [(a, b, (F.col("__fr") if a else 1 - F.col("__fr")) * (F.col("__fc") if b else 1 - F.col("__fc"))) for a in (0, 1) for b in (0, 1)]
    asked = p.withColumn("__ok", inside).select(*keys, "__ok", F.inline(F.array(*(F.struct((F.col("__r0") + a).alias("row"), (F.col("__c0") + b).alias("col"), w.alias("w")) for a, b, w in near))))
    got = asked.join(raster, ["row", "col"], "left").groupBy(*keys).agg(F.max("__ok").alias("ok"), F.sum(F.col("w") * F.col("z")).alias("z"), F.count("z").alias("n"))
    z = F.when(F.col("ok") & (F.col("n") == len(near)) & ~F.isnan("z"), F.col("z")).otherwise(F.lit(fill))
    return got.select(*keys, F.when(z >= 0, F.lit(0.0)).otherwise(-z).alias("depth"))


def cell_reference(lon: Column, lat: Column, west: float, south: float, east: float, north: float, step: float = 0.05, parts: int = 5, detail: str = "cell") -> Column:
    """A map reference like F12, F12c (quadrant) or F12-c3 (part of 5 x 5); letters run east, rows count from the north. Null outside.

    Truncates toward zero, so that a point less than a cell west or north of the lattice counts to its first cells.
    """
    trunc = lambda c: c.cast("int")
    ncol, nrow = round((east - west) / step), round((north - south) / step)
    col, row = trunc((lon - west) / step), trunc((F.lit(north) - lat) / step) + 1
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    letter = lambda c, low=False: F.substring(F.lit(letters.lower() if low else letters), c + 1, 1)
    name = F.concat(letter(col), row.cast("string"))
    x0, y1 = U.tick(west, step, col), U.tick(north, -step, row, -1)
    if detail == "quadrant":
        xm, ym = U.tick(west, step, col, 0.5), U.tick(north, -step, row, -0.5)
        name = F.concat(name, F.when(lat >= ym, F.when(lon < xm, "a").otherwise("b")).otherwise(F.when(lon < xm, "c").otherwise("d")))
    elif detail == "part":
        sub_c, sub_r = F.least(trunc((lon - x0) / step * parts), F.lit(parts - 1)), F.least(trunc((y1 - lat) / step * parts), F.lit(parts - 1)) + 1
        name = F.concat(name, F.lit("-"), letter(sub_c, True), sub_r.cast("string"))
    return F.when((col >= 0) & (col < ncol) & (row >= 1) & (row <= nrow), name)


def snap_to_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, node_id, dist): the node nearest to each point (name, lon, lat) on the sphere, the least id of equals.

    The points are a short list given by hand, such as river mouths; the nodes stay where they are, and each task
    returns its own best before one row per point is shuffled.
    """
    d = T.haversine(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    listed = points.select(F.collect_list(F.struct("name", "lon", "lat")).alias("__p"))
    given = listed.first()["__p"]
    if not given:
        return points.select("name", F.lit(None).cast("long").alias("node_id"), F.lit(None).cast("double").alias("dist"))
    each = F.array(*(F.struct(F.lit(p["name"]).alias("name"), F.lit(float(p["lon"])).alias("lon"), F.lit(float(p["lat"])).alias("lat")) for p in given))
    asked = nodes.select("node_id", "x", "y", F.inline(each)).withColumn("dist", d)
    return asked.groupBy("name").agg(F.min_by("node_id", F.struct("dist", "node_id")).alias("node_id"), F.min("dist").alias("dist"))
