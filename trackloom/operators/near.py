"""Points near points, and points in regions, by hashing to grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geo import EARTH_RADIUS_M, great_circle_m
from trackloom.functions.wkt import polygon_parts, ring_edges
from trackloom.plans.joins import cell_join
from trackloom.plans.stage import staged

#: A polygon is covered by about this many cells across its longer side.
CELLS_ACROSS = 24
MIN_LEVEL, MAX_LEVEL = -9, 22


def _on_sphere(lng: Column, lat: Column) -> tuple[Column, Column]:
    """The same point of the sphere with lng in [-180, 180) and lat in [-90, 90]."""
    usual = (F.abs(lng) < 180) & (F.abs(lat) <= 90)
    turn = F.pmod(lat + 180, F.lit(360.0)) - 180
    over = F.abs(turn) > 90
    lat2 = F.when(over, F.signum(turn) * 180 - turn).otherwise(turn)
    lng2 = F.pmod(F.when(over, lng + 180).otherwise(lng) + 180, F.lit(360.0)) - 180
    return F.when(usual, lng).otherwise(lng2), F.when(usual, lat).otherwise(lat2)


def _cells_in_band(band: Column, height: float) -> tuple[Column, Column]:
    """Number of cells around the globe in a band, and the band's least cosine."""
    top = F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90))
    least = F.greatest(F.cos(F.radians(F.least(top, F.lit(90.0)))), F.lit(1e-7))
    return F.greatest(F.lit(1), F.floor(360.0 / height * least)).cast("bigint"), least


def _key(band: Column, j: Column) -> Column:
    return F.shiftleft(band.cast("bigint"), 32) + j


def within_distance(points: DataFrame, targets: DataFrame, radius_m: float, point_id: str = "ping_id", target_id: str = "target_id") -> DataFrame:
    """point_id, target_id, distance_m of all pairs at most ``radius_m`` apart.

    Both inputs have lng and lat in degrees.  The sphere is cut into bands as
    high as the radius, each band into cells at least as wide; a point has one
    cell, a target the (up to nine) cells its circle touches, so a pair meets
    exactly once and needs no duplicate removal.  The exact great-circle
    distance decides.  Coordinates beyond the usual range mean the same point of
    the sphere; null or infinite ones match nothing.  Equal points each match;
    either side may be empty.
    """
    height = math.degrees(radius_m / EARTH_RADIUS_M) * 1.000001
    finite = (F.abs("lng") < 1e7) & (F.abs("lat") < 1e7)
    lng, lat = _on_sphere(F.col("lng"), F.col("lat"))
    band = F.floor((F.col("_lat") + 90) / height).cast("bigint")
    at = lambda x, n: F.floor((x + 180) / 360 * n).cast("bigint")
    p = points.where(finite).select(F.col(point_id), lng.alias("_lng"), lat.alias("_lat")).withColumn("_b", band)
    n, _ = _cells_in_band(F.col("_b"), height)
    p = p.withColumn("_n", n).select(point_id, F.col("_lng").alias("x"), F.col("_lat").alias("y"), _key(F.col("_b"), F.least(at(F.col("_lng"), F.col("_n")), F.col("_n") - 1)).alias("cell"))
    t = targets.where(finite).select(F.col(target_id), lng.alias("_lng"), lat.alias("_lat")).withColumn("_b", F.explode(F.sequence(band - 1, band + 1)))
    n, least = _cells_in_band(F.col("_b"), height)
    t = t.withColumn("_n", n).withColumn("_w", F.lit(height * 1.01) / F.least(least, F.greatest(F.cos(F.radians("_lat")), F.lit(1e-7))))
    lo, hi = at(F.col("_lng") - F.col("_w"), F.col("_n")), at(F.col("_lng") + F.col("_w"), F.col("_n"))
    span = F.when(hi - lo >= F.col("_n"), F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).otherwise(F.sequence(lo, hi))
    t = t.withColumn("_j", F.explode(span)).select(target_id, F.col("_lng").alias("tx"), F.col("_lat").alias("ty"), _key(F.col("_b"), F.pmod(F.col("_j"), F.col("_n"))).alias("cell"))
    far = great_circle_m(F.col("x"), F.col("y"), F.col("tx"), F.col("ty"))
    return cell_join(p, t, ["cell"]).select(point_id, target_id, far.alias("distance_m")).where(F.col("distance_m") <= radius_m)


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with a ray towards greater x."""
    crossed = F.filter(edges, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]))
    return F.size(crossed) % 2 == 1


def region_cells(regions: DataFrame, region_id: str = "region_id") -> DataFrame:
    """region_id, level, cell, edges: cells that a region covers or cuts.

    ``regions`` has a WKT polygon or multipolygon in ``geometry``; null, empty
    and unreadable ones give nothing.  Cells of level k measure 2**-k degrees;
    every polygon takes the level that puts about 24 cells across it, so its
    size doesn't matter.  Rows of cells keep the edges that reach into them.  A
    cell which no edge touches is wholly in or out; the outer ones are dropped,
    the inner ones have null edges.  A touched cell keeps the edges of its row
    from its left side on, which decide any point in it.
    """
    parts = regions.select(F.col(region_id), F.explode(polygon_parts(F.col("geometry"))).alias("rings"))
    parts = parts.withColumn("part", F.xxhash64(F.col(region_id), F.col("rings").cast("string")))
    parts = parts.withColumn("edges", F.flatten(F.transform("rings", ring_edges)))
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    wide = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys), F.lit(1e-9))
    level = F.greatest(F.lit(MIN_LEVEL), F.least(F.lit(MAX_LEVEL), F.floor(F.log2(F.lit(float(CELLS_ACROSS)) / wide)).cast("int")))
    e = parts.where(F.size("edges") > 2).withColumn("level", level).select(region_id, "part", "level", F.pow(F.lit(2.0), -F.col("level")).alias("w"), F.explode("edges").alias("e"))
    row = lambda y: F.floor(y / F.col("w")).cast("bigint")
    rows = e.withColumn("r", F.explode(F.sequence(row(F.least("e.y1", "e.y2")), row(F.greatest("e.y1", "e.y2")))))
    # x range of the edge within its row
    y0, y1 = F.col("r") * F.col("w"), (F.col("r") + 1) * F.col("w")
    clip = lambda y: F.greatest(y0, F.least(y1, y))
    x_at = lambda y: F.when(F.col("e.y1") == F.col("e.y2"), None).otherwise(F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * (y - F.col("e.y1")) / (F.col("e.y2") - F.col("e.y1")))
    a, b = F.coalesce(x_at(clip(F.col("e.y1"))), F.col("e.x1")), F.coalesce(x_at(clip(F.col("e.y2"))), F.col("e.x2"))
    slack = F.col("w") * 1e-9
    strips = (
        rows.select(region_id, "part", "level", "w", "r", F.struct((F.least(a, b) - slack).alias("lo"), (F.greatest(a, b) + slack).alias("hi"), "e.x1", "e.y1", "e.x2", "e.y2").alias("e"))
        .groupBy(region_id, "part", "level", "w", "r")
        .agg(F.collect_list("e").alias("es"))
    )
    col = lambda x: F.floor(x / F.col("w")).cast("bigint")
    cells = strips.withColumn("c", F.explode(F.sequence(col(F.array_min(F.transform("es", lambda e: e["lo"]))), col(F.array_max(F.transform("es", lambda e: e["hi"]))))))
    left, right = F.col("c") * F.col("w"), (F.col("c") + 1) * F.col("w")
    cells = cells.withColumn("cut", F.exists("es", lambda e: (e["hi"] >= left) & (e["lo"] <= right)))
    kept = F.filter("es", lambda e: e["hi"] >= left)
    cells = cells.where(F.col("cut") | _inside(F.col("es"), left + F.col("w") / 2, (F.col("r") + 0.5) * F.col("w")))
    return cells.select(region_id, "part", "level", F.col("r").alias("cell_y"), F.col("c").alias("cell_x"), F.when(F.col("cut"), kept).alias("edges"))


def containing_regions(points: DataFrame, regions: DataFrame, point_id: str = "ping_id", region_id: str = "region_id") -> DataFrame:
    """point_id, region_id of every region that contains the point.

    Edges are straight in (lng, lat), holes are outside, overlapping regions
    each count, a region of several pieces counts once.  A point meets the cells
    of ``region_cells`` on the levels in use (at most 32, collected); the even-odd
    rule over a cut cell's own edges decides.  Points on an edge follow that
    rule (left and lower edges are inside).  Null or infinite coordinates match
    nothing; either side may be empty.
    """
    # read for the levels, for its size and for the join
    cells = staged(region_cells(regions, region_id))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())
    if not levels:
        return points.select(point_id).join(regions.select(region_id).limit(0), F.lit(False))
    at = lambda c, k: F.floor(F.col(c) * (2.0**k)).cast("bigint")
    usable = (F.abs("lng") <= 180) & (F.abs("lat") <= 90)
    hashed = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), at("lat", k).alias("cell_y"), at("lng", k).alias("cell_x")) for k in levels]))
    p = points.where(usable).select(point_id, "lng", "lat", hashed.alias("h")).select(point_id, "lng", "lat", "h.*")
    hit = cell_join(p, cells, ["level", "cell_y", "cell_x"])
    inside = hit.where(F.col("edges").isNull() | _inside(F.col("edges"), F.col("lng"), F.col("lat")))
    pieces = regions.where(F.size(polygon_parts(F.col("geometry"))) > 1).limit(1).count()
    out = inside.select(point_id, region_id)
    return out.distinct() if pieces else out
