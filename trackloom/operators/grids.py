"""Fishnets, curves and control-point registration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.wkt import polygon_parts, ring_edges


def fishnet(spark: SparkSession, min_x: float, min_y: float, max_x: float, max_y: float, step_x: float, step_y: float | None = None) -> DataFrame:
    """grid_id (from 1), dx (row), dy (column), xmin, ymin, xmax, ymax of cells from the upper left on.

    There are ceil(extent / step) + 1 rows and columns; cells that don't touch
    the box are left out after numbering.
    """
    step_y = step_y or step_x
    rows, cols = math.ceil((max_y - min_y) / step_y) + 1, math.ceil((max_x - min_x) / step_x) + 1
    g = spark.range(rows * cols).select((F.col("id") + 1).alias("grid_id"), F.floor(F.col("id") / cols).alias("dx"), (F.col("id") % cols).alias("dy"))
    left, top = F.lit(min_x) + F.col("dy") * F.lit(step_x), F.lit(max_y) - F.col("dx") * F.lit(step_y)
    g = g.select("grid_id", "dx", "dy", left.alias("xmin"), (top - step_y).alias("ymin"), (left + step_x).alias("xmax"), top.alias("ymax"))
    return g.where((F.col("xmin") <= max_x) & (F.col("ymax") >= min_y))


def bounds(df: DataFrame, pts: str = "pts") -> DataFrame:
    """One row: min_x, min_y, max_x, max_y, mean_x, mean_y and the middle mid_x, mid_y of all points of lines."""
    p = df.select(F.explode(pts).alias("p"))
    b = p.agg(*[f(f"p.{c}").alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg)) for c in "xy"])
    return b.withColumn("mid_x", (F.col("min_x") + F.col("max_x")) / 2).withColumn("mid_y", (F.col("min_y") + F.col("max_y")) / 2)


def cells_in(grid: DataFrame, polygons: DataFrame) -> DataFrame:
    """Cells of a fishnet that touch one of the polygons (geometry as WKT, in the grid's coordinates).

    A cell touches a polygon if an edge crosses the cell or the cell's middle lies
    inside; both are found by the cells an edge's box covers and by rows of edges
    towards greater x, never by all pairs.
    """
    g = grid.agg(F.min("xmin").alias("x0"), F.max("ymax").alias("y0"), F.first(F.col("xmax") - F.col("xmin")).alias("sx"), F.first(F.col("ymax") - F.col("ymin")).alias("sy")).first()
    if g["x0"] is None:
        return grid
    # a repeated polygon counts once
    rings = polygons.select(F.explode(polygon_parts(F.col("geometry"))).alias("rings")).distinct()
    parts = rings.select(F.xxhash64(F.col("rings").cast("string")).alias("part"), F.flatten(F.transform("rings", ring_edges)).alias("e")).select("part", F.explode("e").alias("e"))
    e = parts.select("part", "e.*")
    row = lambda y: F.floor((g["y0"] - y) / g["sy"]).cast("bigint")
    col = lambda x: F.floor((x - g["x0"]) / g["sx"]).cast("bigint")
    rows = e.withColumn("dx", F.explode(F.sequence(row(F.greatest("y1", "y2")), row(F.least("y1", "y2")))))
    top, bottom = F.lit(g["y0"]) - F.col("dx") * g["sy"], F.lit(g["y0"]) - (F.col("dx") + 1) * g["sy"]
    clip = lambda y: F.greatest(bottom, F.least(top, y))
    x_at = lambda y: F.when(F.col("y1") == F.col("y2"), None).otherwise(F.col("x1") + (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")))
    a, b = F.coalesce(x_at(clip(F.col("y1"))), F.col("x1")), F.coalesce(x_at(clip(F.col("y2"))), F.col("x2"))
    cut = rows.withColumn("dy", F.explode(F.sequence(col(F.least(a, b)), col(F.greatest(a, b))))).select("dx", "dy").distinct()
    # middles inside: edges of a row that cross the height of its middle, counted to the right of each column
    middle = F.lit(g["y0"]) - (F.col("dx") + 0.5) * g["sy"]
    hits = rows.where((F.col("y1") > middle) != (F.col("y2") > middle)).select("part", "dx", (F.col("x1") + (F.col("x2") - F.col("x1")) * (middle - F.col("y1")) / (F.col("y2") - F.col("y1"))).alias("x"))
    runs = hits.groupBy("part", "dx").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    spans = runs.select("dx", F.explode(F.transform(F.filter(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: i % 2 == 1), lambda i: F.struct(F.get("xs", i - 1).alias("a"), F.get("xs", i).alias("b")))).alias("s")).select("dx", "s.*")
    lo, hi = F.ceil((F.col("a") - g["x0"]) / g["sx"] - 0.5).cast("bigint"), F.floor((F.col("b") - g["x0"]) / g["sx"] - 0.5).cast("bigint")
    inside = spans.withColumn("dy", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")))).select("dx", "dy").distinct()
    return grid.join(cut.unionByName(inside).distinct(), ["dx", "dy"], "left_semi")


def degree_steps(lng: float, lat: float, step_m: float) -> tuple[float, float]:
    """Degrees of longitude and latitude that measure ``step_m`` at a place, on the WGS84 ellipsoid."""
    from trackloom.functions.projection import FLAT, A

    e2 = FLAT * (2 - FLAT)
    s = 1 - e2 * math.sin(math.radians(lat)) ** 2
    return math.degrees(step_m / (A / math.sqrt(s) * math.cos(math.radians(lat)))), math.degrees(step_m / (A * (1 - e2) / s**1.5))


def bezier(x1: Column, y1: Column, x2: Column, y2: Column, bend: float = 0.25, n: int = 20, right: bool = True) -> Column:
    """array<struct<x,y>> of n points on the quadratic curve whose control point lies ``bend`` lengths beside the middle."""
    side = -1.0 if right else 1.0
    cx, cy = (x1 + x2) / 2 - (y2 - y1) * (side * bend), (y1 + y2) / 2 + (x2 - x1) * (side * bend)

    def at(k: Column) -> Column:
        t = k / F.lit(float(n - 1))
        u = 1 - t
        return F.struct((u * u * x1 + 2 * u * t * cx + t * t * x2).alias("x"), (u * u * y1 + 2 * u * t * cy + t * t * y2).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def arc(x1: Column, y1: Column, x2: Column, y2: Column, radius: float = 1.0, n: int = 20, right: bool = True) -> Column:
    """array<struct<x,y>> of n points on the circle of ``radius`` chord lengths through both ends.

    Radii of 0.72 and less are taken as 0.8; half the chord is the least possible.
    """
    r = 0.8 if radius <= 0.72 else radius
    half = math.asin(0.5 / r)
    side = -1.0 if right else 1.0
    away = math.sqrt(r * r - 0.25)
    dx, dy = x2 - x1, y2 - y1
    cx, cy = (x1 + x2) / 2 + dy * (side * away), (y1 + y2) / 2 - dx * (side * away)
    chord = F.sqrt(dx * dx + dy * dy)
    start = F.atan2(y1 - cy, x1 - cx)

    def at(k: Column) -> Column:
        a = start - side * (k / F.lit(float(n - 1))) * (2 * half)
        return F.struct((cx + chord * r * F.cos(a)).alias("x"), (cy + chord * r * F.sin(a)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


#: The sums that both fits need, each a plain aggregate.
SUMS = {"n": "1", "px": "px", "py": "py", "ax": "ax", "ay": "ay", "pxx": "px * px", "pyy": "py * py", "pxy": "px * py", "pxax": "px * ax", "pxay": "px * ay", "pyax": "py * ax", "pyay": "py * ay"}


def control_sums(pairs: DataFrame) -> DataFrame:
    """One row with the sums over pairs of pixel (px, py) and actual (ax, ay) coordinates."""
    return pairs.where("px is not null and py is not null and ax is not null and ay is not null").agg(*[F.sum(F.expr(e).cast("double")).alias(k) for k, e in SUMS.items()])


def fit(pairs: DataFrame, method: str = "affine") -> np.ndarray:
    """3x3 matrix M with (x, y, 1) M = (X, Y, 1), by least squares; 'affine' or 'helmert'.

    At least three pairs are needed.  Only the sums come to the driver.
    """
    s = control_sums(pairs).first()
    if s["n"] is None or s["n"] < 3:
        raise ValueError("registration needs at least three pairs of points")
    if method == "affine":
        a = np.array([[s["pxx"], s["pxy"], s["px"]], [s["pxy"], s["pyy"], s["py"]], [s["px"], s["py"], s["n"]]])
        m = np.linalg.solve(a, np.array([[s["pxax"], s["pxay"]], [s["pyax"], s["pyay"]], [s["ax"], s["ay"]]]))
        return np.column_stack([m, [0, 0, 1]])
    # X = a x - b y + dx, Y = b x + a y + dy
    q = s["pxx"] + s["pyy"]
    lhs = np.array([[q, 0, s["px"], s["py"]], [0, q, -s["py"], s["px"]], [s["px"], -s["py"], s["n"], 0], [s["py"], s["px"], 0, s["n"]]])
    a, b, dx, dy = np.linalg.solve(lhs, np.array([s["pxax"] + s["pyay"], s["pxay"] - s["pyax"], s["ax"], s["ay"]]))
    return np.array([[a, b, 0], [-b, a, 0], [dx, dy, 1]])


def apply_matrix(df: DataFrame, m: np.ndarray, x: str = "px", y: str = "py") -> DataFrame:
    """Adds gx, gy."""
    c = lambda k: F.col(x) * float(m[0, k]) + F.col(y) * float(m[1, k]) + float(m[2, k])
    return df.withColumn("gx", c(0)).withColumn("gy", c(1))
