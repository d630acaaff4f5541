"""Point tables and lines from CSV and GeoJSON."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trilattice.sources.mesh_text import numbered_lines

#: Accepted column names, in lower case. Fixed values.
LON, LAT = ("lon", "longitude", "x"), ("lat", "latitude", "y")


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """(seq, lon, lat) of a CSV file with a header, in the order of its rows; fields may be quoted, but hold no line break."""
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    head = lines.where("line = 0").first()
    names = [c.strip().lower() for c in next(csv.reader([head.value]))] if head else []
    lon, lat = (next((i for i, c in enumerate(names) if c in keys), None) for keys in (LON, LAT))
    if lon is None or lat is None:
        raise ValueError(f"{path}: no pair of lon and lat columns among {names}")
    fields = F.from_csv("value", ", ".join(f"c{i} string" for i in range(len(names))))
    rows = lines.where("line > 0").select((F.col("line") - 1).alias("seq"), fields.alias("f"))
    return rows.select("seq", F.trim(f"f.c{lon}").cast("double").alias("lon"), F.trim(f"f.c{lat}").cast("double").alias("lat"))


def read_lines_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, pos, x, y) of the lines, and of the rings of polygons, of a GeoJSON feature collection.

    Coordinates stay text until their nesting is known from the geometry's type.
    """
    features = spark.read.schema("features array<struct<geometry: struct<type: string, coordinates: string>>>").option("multiLine", True).json(path)
    g = features.select(F.posexplode("features").alias("feature", "f")).select("feature", "f.geometry.type", "f.geometry.coordinates")
    line, lines, polygons = "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    kind = F.col("type")
    parts = (
        F.when(kind == "LineString", F.array(F.from_json("coordinates", line)))
        .when(kind.isin("MultiLineString", "Polygon"), F.from_json("coordinates", lines))
        .when(kind == "MultiPolygon", F.flatten(F.from_json("coordinates", polygons)))
    )
    each = g.select("feature", F.posexplode(parts).alias("part", "xy"))
    return each.select((F.col("feature") * 1_000_000 + F.col("part")).cast("long").alias("line_id"), F.posexplode("xy").alias("pos", "p")).select("line_id", "pos", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def clip_segments(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """segments (x0, y0, x1, y1, ...) cut at a box (xmin, ymin, xmax, ymax); those outside go.

    Liang and Barsky's bounds on the parameter along the segment, as column expressions.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    low, high, keep = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, F.col("x0") - box[0]), (dx, F.lit(box[2]) - F.col("x0")), (-dy, F.col("y0") - box[1]), (dy, F.lit(box[3]) - F.col("y0"))):
        t = F.when(p != 0, q / p)
        low = F.greatest(low, F.when(p < 0, t).otherwise(F.lit(0.0)))
        high = F.least(high, F.when(p > 0, t).otherwise(F.lit(1.0)))
        keep = keep & ((p != 0) | (q >= 0))
    cut = segments.withColumns({"__low": low, "__high": high}).where(keep & (F.col("__low") <= F.col("__high")))
    at = lambda a, d, t: F.col(a) + F.col(t) * d
    return cut.withColumns({"x0": at("x0", dx, "__low"), "y0": at("y0", dy, "__low"), "x1": at("x0", dx, "__high"), "y1": at("y0", dy, "__high")}).drop("__low", "__high")
