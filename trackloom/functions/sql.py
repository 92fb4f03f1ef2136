"""The engine's expressions as SQL functions, and its generators as table functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from trackloom.functions.geo import EARTH_RADIUS_M

#: name, parameters, type and body of the scalar functions; their bodies are inlined into the plan.
SCALARS = {
    "great_circle_m": ("lng1 DOUBLE, lat1 DOUBLE, lng2 DOUBLE, lat2 DOUBLE", "DOUBLE", f"2 * {EARTH_RADIUS_M} * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2))))"),
    "plane_distance_m": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"),
    "north_angle_deg": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "pmod(degrees(atan2(x2 - x1, y2 - y1)), 360D)"),
    "vector_angle_deg": ("x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE", "DOUBLE", "coalesce(degrees(acos(greatest(-1D, least(1D, try_divide(x1 * x2 + y1 * y2, sqrt(x1 * x1 + y1 * y1) * sqrt(x2 * x2 + y2 * y2)))))), 0D)"),
    "utm_zone": ("lng DOUBLE", "INT", "CAST(greatest(1, least(60, floor((lng + 180) / 6) + 1)) AS INT)"),
    "grid_cell_s": ("s BIGINT, step BIGINT", "BIGINT", "CAST(floor(s / step) * step AS BIGINT)"),
    "line_length_m": ("pts ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>", "DOUBLE", "aggregate(zip_with(slice(pts, 1, greatest(size(pts) - 1, 0)), slice(pts, 2, greatest(size(pts) - 1, 0)), (p, q) -> sqrt(pow(q.x - p.x, 2) + pow(q.y - p.y, 2))), 0D, (a, d) -> a + d)"),
}


@udtf(returnType="k: int, t_s: double, x_m: double, y_m: double")
class Densified:
    """densified(t1, x1, y1, t2, x2, y2, interval): the first point and evenly spaced ones before the second."""

    def eval(self, t1: float, x1: float, y1: float, t2: float, x2: float, y2: float, interval: float) -> Iterator[tuple]:
        if None in (t1, x1, y1):
            return
        d = math.hypot(x2 - x1, y2 - y1) if None not in (t2, x2, y2) else 0.0
        n = int(d / interval + 0.001) + 1 if d > interval else 1
        for k in range(n):
            f = k / n
            yield k, t1 + (t2 - t1) * f if k else t1, x1 + (x2 - x1) * f if k else x1, y1 + (y2 - y1) * f if k else y1


@udtf(returnType="grid_id: bigint, dx: bigint, dy: bigint, xmin: double, ymin: double, xmax: double, ymax: double")
class Fishnet:
    """fishnet(min_x, min_y, max_x, max_y, step): cells from the upper left on, as operators.grids.fishnet."""

    def eval(self, min_x: float, min_y: float, max_x: float, max_y: float, step: float) -> Iterator[tuple]:
        rows, cols = math.ceil((max_y - min_y) / step) + 1, math.ceil((max_x - min_x) / step) + 1
        for i in range(rows * cols):
            left, top = min_x + i % cols * step, max_y - i // cols * step
            if left <= max_x and top >= min_y:
                yield i + 1, i // cols, i % cols, left, top - step, left + step, top


@udtf(returnType="k: int, x: double, y: double")
class Curve:
    """curve(x1, y1, x2, y2, bend, n): n points on the quadratic curve bent to the right by ``bend`` lengths."""

    def eval(self, x1: float, y1: float, x2: float, y2: float, bend: float, n: int) -> Iterator[tuple]:
        cx, cy = (x1 + x2) / 2 + (y2 - y1) * bend, (y1 + y2) / 2 - (x2 - x1) * bend
        for k in range(n):
            t = k / (n - 1) if n > 1 else 0.0
            u = 1 - t
            yield k, u * u * x1 + 2 * u * t * cx + t * t * x2, u * u * y1 + 2 * u * t * cy + t * t * y2


TABLES = {"densified": Densified, "fishnet": Fishnet, "curve": Curve}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to ``spark.sql`` of this session; returns their names."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, table in TABLES.items():
        spark.udtf.register(name, table)
    return [*SCALARS, *TABLES]
