"""Well-known text to arrays of coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"([-+]?\d+\.?\d*(?:[eE][-+]?\d+)?)"


def point_xy(wkt: Column) -> Column:
    """struct<x,y> of a WKT point; null for null, empty or unreadable text."""
    pattern = r"(?i)^\s*(?:SRID=\d+;)?\s*POINT\s*Z?M?\s*\(\s*" + _NUMBER + r"\s+" + _NUMBER
    x, y = F.regexp_extract(wkt, pattern, 1), F.regexp_extract(wkt, pattern, 2)
    return F.when(F.length(x) > 0, F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def _points(body: Column) -> Column:
    """array<struct<x,y>> of 'x y, x y'; extra ordinates are ignored."""
    return F.transform(F.split(F.btrim(body, F.lit(" ()")), r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).cast("double").alias("y")))


def line_points(wkt: Column) -> Column:
    """array<struct<x,y>> of a WKT line string; null for anything else."""
    body = F.regexp_extract(wkt, r"(?i)^\s*(?:SRID=\d+;)?\s*LINESTRING\s*Z?M?\s*\((.*)\)\s*$", 1)
    return F.when(F.length(F.trim(body)) > 0, _points(body))


def polygon_parts(wkt: Column) -> Column:
    """array of polygons, each an array of rings of points; null if there is none."""
    body = F.regexp_extract(wkt, r"(?is)^\s*(?:SRID=\d+;)?\s*(?:MULTI)?POLYGON\s*Z?M?\s*(\(.*\))\s*$", 1)
    return F.when(
        F.length(body) > 0,
        F.transform(F.split(body, r"\)\s*\)\s*,\s*\(\s*\("), lambda part: F.transform(F.split(part, r"\)\s*,\s*\("), _points)),
    )


def ring_edges(ring: Column) -> Column:
    """array<struct<x1,y1,x2,y2>> of a ring, closed if it isn't."""
    nxt = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    edges = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), nxt(i)["x"].alias("x2"), nxt(i)["y"].alias("y2")))
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))
