"""Lines as array<struct<x,y>> in metres: measures along them, pieces, cleaning, covering.

Everything is exploded to segments and put together again by keys, so a line's
length is no limit; kernels run only where segments of one line must be compared
with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.network import along_cells, segments
from trackloom.plans.joins import cell_join

POINTS = "array<struct<x: double, y: double>>"


def xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def clean_points(pts: Column) -> Column:
    """The points without those that repeat the one before; a vertex that is come back to stays."""
    return F.filter(pts, lambda p, i: (i == 0) | ~p.eqNullSafe(F.get(pts, i - 1)))


def line_pieces(lines: DataFrame, pieces: DataFrame, key: str = "link_id") -> DataFrame:
    """key, piece, pts: the parts of lines between two measures.

    ``lines`` has key and pts; ``pieces`` key, piece, from_m and to_m with from_m
    < to_m.  Measures beyond a line's ends are taken as its ends; a piece that
    doesn't touch its line gives no row.
    """
    s = segments(lines.select(F.col(key).alias("link_id"), "pts")).withColumnRenamed("link_id", key)
    s = s.select(key, "topo_seq", "x1", "y1", "x2", "y2", "seg_length", (F.col("seg_acc") - F.col("seg_length")).alias("before"), F.col("seg_acc").alias("upto"))
    j = pieces.select(key, "piece", "from_m", "to_m").join(s, key).where((F.col("before") < F.col("to_m")) & (F.col("upto") > F.col("from_m")))
    at = lambda m: F.coalesce(F.try_divide(m - F.col("before"), F.col("seg_length")), F.lit(0.0))
    point = lambda f: xy(F.col("x1") + f * (F.col("x2") - F.col("x1")), F.col("y1") + f * (F.col("y2") - F.col("y1")))
    a = F.when(F.col("from_m") > F.col("before"), point(at(F.col("from_m")))).otherwise(xy(F.col("x1"), F.col("y1")))
    z = F.when(F.col("to_m") < F.col("upto"), point(at(F.col("to_m")))).otherwise(xy(F.col("x2"), F.col("y2")))
    g = j.select(key, "piece", F.struct("topo_seq", a.alias("a"), z.alias("z")).alias("e")).groupBy(key, "piece").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return g.select(key, "piece", clean_points(F.concat(F.array(F.col("e")[0]["a"]), F.transform("e", lambda e: e["z"]))).alias("pts"))


def nearest_on_lines(points: DataFrame, lines: DataFrame, radius: float, point: str = "point_id", key: str = "link_id") -> DataFrame:
    """point, key, dist_m, along_m, px, py: every line within ``radius`` of a point, by its nearest place, of equal ones the first.

    ``points`` has point, x and y, ``lines`` key and pts.  Segments are spread over
    the cells along them, a point has one cell, the exact distance decides.
    """
    cell = lambda c: F.floor(c / radius).cast("bigint")
    s = segments(lines.select(F.col(key).alias("link_id"), "pts")).withColumnRenamed("link_id", key)
    s = s.select(key, "topo_seq", "x1", "y1", "x2", "y2", "seg_length", (F.col("seg_acc") - F.col("seg_length")).alias("before"))
    s = along_cells(s, radius, radius)
    p = points.where("x is not null and y is not null").select(point, F.col("x").alias("_x"), F.col("y").alias("_y"), cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    f = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("_x") - F.col("x1")) * ux + (F.col("_y") - F.col("y1")) * uy, ux * ux + uy * uy))), F.lit(0.0))
    j = cell_join(p, s, ["cx", "cy"]).withColumn("_f", f).withColumn("px", F.col("x1") + F.col("_f") * ux).withColumn("py", F.col("y1") + F.col("_f") * uy)
    j = j.withColumn("dist_m", F.sqrt((F.col("px") - F.col("_x")) ** 2 + (F.col("py") - F.col("_y")) ** 2)).where(F.col("dist_m") <= radius)
    best = F.min(F.struct("dist_m", "topo_seq", (F.col("before") + F.col("_f") * F.col("seg_length")).alias("along_m"), "px", "py")).alias("b")
    return j.groupBy(point, key).agg(best).select(point, key, "b.dist_m", "b.along_m", "b.px", "b.py")


def sampled(lines: DataFrame, every_m: float, key: str = "link_id") -> DataFrame:
    """key, k, x, y, dx, dy: the middles of about equal parts of at most ``every_m`` of each segment, and its direction."""
    s = segments(lines.select(F.col(key).alias("link_id"), "pts")).withColumnRenamed("link_id", key).where("seg_length > 0")
    n = F.ceil(F.col("seg_length") / every_m).cast("int")
    s = s.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("_f", (F.col("_i") - 0.5) / F.col("_n"))
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return s.select(key, F.struct("topo_seq", "_i").alias("k"), (F.col("x1") + F.col("_f") * ux).alias("x"), (F.col("y1") + F.col("_f") * uy).alias("y"), ux.alias("dx"), uy.alias("dy"), (F.col("seg_length") / F.col("_n")).alias("part_m"))


def coverage(lines: DataFrame, others: DataFrame, buffer_m: float, every_m: float = 5.0, key: str = "link_id") -> DataFrame:
    """key, other, share, cosine: the share of each line's length that lies within ``buffer_m`` of each other line.

    Lines are sampled every ``every_m``; cosine is that of the mean angle between
    their directions there, weighted by length, -1 where they run against each
    other.  ``others`` has other and pts.  Pairs that don't touch have no row.
    """
    p = sampled(lines, every_m, key)
    s = segments(others.select(F.col("other").alias("link_id"), "pts")).withColumnRenamed("link_id", "other").where("seg_length > 0")
    cell = lambda c: F.floor(c / buffer_m).cast("bigint")
    s = along_cells(s.select("other", "x1", "y1", "x2", "y2", "seg_length"), buffer_m, buffer_m)
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x1")) * ux + (F.col("y") - F.col("y1")) * uy) / (ux * ux + uy * uy)))
    j = cell_join(p.withColumn("cx", cell(F.col("x"))).withColumn("cy", cell(F.col("y"))), s, ["cx", "cy"]).withColumn("_f", f)
    d = F.sqrt((F.col("x1") + F.col("_f") * ux - F.col("x")) ** 2 + (F.col("y1") + F.col("_f") * uy - F.col("y")) ** 2)
    cos = (F.col("dx") * ux + F.col("dy") * uy) / (F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2) * F.col("seg_length"))
    near = j.select(key, "other", "k", "part_m", d.alias("d"), cos.alias("cos")).where(F.col("d") <= buffer_m).groupBy(key, "other", "k").agg(F.first("part_m").alias("part_m"), F.min(F.struct("d", "cos")).alias("b"))
    length = p.groupBy(key).agg(F.sum("part_m").alias("_all"))
    g = near.groupBy(key, "other").agg(F.sum("part_m").alias("_m"), (F.sum(F.col("b.cos") * F.col("part_m")) / F.sum("part_m")).alias("cosine"))
    return g.join(length, key).select(key, "other", (F.col("_m") / F.col("_all")).alias("share"), "cosine")


def crossings(x: np.ndarray, y: np.ndarray) -> list[tuple[int, float]]:
    """(segment, share of it) of every place at which a line meets itself, neighbours aside."""
    n = len(x) - 1
    out: list[tuple[int, float]] = []
    for i in range(n - 1):
        j = np.arange(i + 2, n)
        ax, ay, bx, by = x[i + 1] - x[i], y[i + 1] - y[i], x[j + 1] - x[j], y[j + 1] - y[j]
        det = ax * by - ay * bx
        with np.errstate(divide="ignore", invalid="ignore"):
            f = ((x[j] - x[i]) * by - (y[j] - y[i]) * bx) / det
            g = ((x[j] - x[i]) * ay - (y[j] - y[i]) * ax) / det
        hit = (det != 0) & (f >= 0) & (f <= 1) & (g >= 0) & (g <= 1)
        # the ends of a closed line touch, which is no crossing within it
        for k, a, b in zip(j[hit], f[hit], g[hit]):
            if not (i == 0 and a == 0 and k == n - 1 and b == 1):
                out += [(i, float(a)), (int(k), float(b))]
    return sorted(set(out))


def simple_lines(lines: DataFrame, key: str = "link_id") -> DataFrame:
    """key, piece, pts of lines without self-intersections.

    Repeated points are taken off; lines are cut where they meet themselves, and
    closed ones in their middle; what has less than two points is left out.
    """

    def cut(x: np.ndarray, y: np.ndarray) -> list[list[tuple[float, float]]]:
        at = crossings(x, y)
        if x[0] == x[-1] and y[0] == y[-1] and not at:
            at = [(len(x) // 2, 0.0)] if len(x) > 3 else [(1, 0.0)]
        out, run = [], [(x[0], y[0])]
        for i in range(len(x) - 1):
            for f in [f for k, f in at if k == i]:
                p = (x[i] + f * (x[i + 1] - x[i]), y[i] + f * (y[i + 1] - y[i]))
                if p != run[-1]:
                    run.append(p)
                if len(run) > 1:
                    out.append(run)
                    run = [p]
            if (x[i + 1], y[i + 1]) != run[-1]:
                run.append((x[i + 1], y[i + 1]))
        return out + ([run] if len(run) > 1 else [])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, pts in zip(b[key], b["pts"]):
                x, y = np.array([p["x"] for p in pts]), np.array([p["y"] for p in pts])
                rows += [(k, i, [{"x": float(u), "y": float(v)} for u, v in part]) for i, part in enumerate(cut(x, y))]
            yield pd.DataFrame(rows, columns=[key, "piece", "pts"])

    kind = dict(lines.dtypes)[key]
    return lines.select(key, clean_points(F.col("pts")).alias("pts")).where(F.size("pts") >= 2).mapInPandas(run, f"`{key}` {kind}, piece int, pts {POINTS}")


def within_route(links: DataFrame, route: DataFrame, radius: float, key: str = "link_id") -> DataFrame:
    """agent_id, key of the lines that come within ``radius`` of an agent's way.

    ``route`` has agent_id, seq, x_m and y_m.  The way is the segments between
    consecutive points; two segments are at most ``radius`` apart where one's end
    is that near to the other or they cross, which is tested on the candidates of
    equal cells.  No polygon is built.
    """
    w = Window.partitionBy("agent_id").orderBy("seq")
    r = route.select("agent_id", F.col("x_m").alias("ax"), F.col("y_m").alias("ay"), F.coalesce(F.lead("x_m").over(w), "x_m").alias("bx"), F.coalesce(F.lead("y_m").over(w), "y_m").alias("by")).distinct()
    s = segments(links.select(F.col(key).alias("link_id"), "pts")).withColumnRenamed("link_id", key).select(key, "x1", "y1", "x2", "y2")
    cell = lambda c: F.floor(c / (4 * radius)).cast("bigint")
    over = lambda a, b, m: F.explode(F.sequence(cell(F.least(F.col(a), F.col(b)) - m), cell(F.greatest(F.col(a), F.col(b)) + m)))
    r = r.withColumn("cx", over("ax", "bx", radius)).withColumn("cy", over("ay", "by", radius))
    s = s.withColumn("cx", over("x1", "x2", 0.0)).withColumn("cy", over("y1", "y2", 0.0))
    c = F.col

    def off(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        ux, uy = x2 - x1, y2 - y1
        f = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x1) * ux + (py - y1) * uy, ux * ux + uy * uy))), F.lit(0.0))
        return F.sqrt((x1 + f * ux - px) ** 2 + (y1 + f * uy - py) ** 2)

    def side(px: Column, py: Column, qx: Column, qy: Column, rx: Column, ry: Column) -> Column:
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    a, b, p, q = (c("ax"), c("ay")), (c("bx"), c("by")), (c("x1"), c("y1")), (c("x2"), c("y2"))
    cross = (side(*a, *b, *p) * side(*a, *b, *q) < 0) & (side(*p, *q, *a) * side(*p, *q, *b) < 0)
    near = F.least(off(*a, *p, *q), off(*b, *p, *q), off(*p, *a, *b), off(*q, *a, *b)) <= radius
    return cell_join(r, s, ["cx", "cy"]).where(cross | near).select("agent_id", key).distinct()
