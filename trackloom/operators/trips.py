"""Trips, stays within them, and origin-destination records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import great_circle_m
from trackloom.functions.wkt import polygon_parts
from trackloom.operators.cleaning import by_agent, plane_distance
from trackloom.operators.near import containing_regions
from trackloom.plans.numbering import number_rows
from trackloom.plans.stage import staged


def main_trips(points: DataFrame, threshold_s: int = 1800) -> DataFrame:
    """Adds trip_no, from 1 for each agent: a gap of more than ``threshold_s`` to the previous point begins a trip."""
    w = by_agent()
    opens = F.when(F.coalesce(F.col("t_s") - F.lag("t_s").over(w) > threshold_s, F.lit(True)), 1).otherwise(0)
    return points.withColumn("_o", opens).withColumn("trip_no", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")


def trip_summary(trips: DataFrame) -> DataFrame:
    """agent_id, trip_no, n_points, start_s, end_s, length_m over consecutive points of each trip."""
    w = Window.partitionBy("agent_id", "trip_no").orderBy("seq")
    d = plane_distance(F.lag("x_m").over(w), F.lag("y_m").over(w), F.col("x_m"), F.col("y_m"))
    return trips.withColumn("_d", d).groupBy("agent_id", "trip_no").agg(F.count(F.lit(1)).alias("n_points"), F.min("t_s").alias("start_s"), F.max("t_s").alias("end_s"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length_m"))


def sub_trips(trips: DataFrame, min_distance_m: float = 10.0, n: int = 5, dwell_s: float = 60.0) -> DataFrame:
    """Cuts trips at stays: agent_id, trip_no, sub_no and the remaining points.

    A point rests if it is nearer than ``min_distance_m`` to the previous one of
    its trip.  Runs of more than ``n`` resting points are stays.  A stay and the
    point before it are collapsed to their last point; if the stay's gaps add up
    to more than ``dwell_s``, a new sub-trip begins at it.  Only gaps within the
    trip count.
    """
    w = Window.partitionBy("agent_id", "trip_no").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = plane_distance(F.lag("x_m").over(w), F.lag("y_m").over(w), F.col("x_m"), F.col("y_m"))
    p = trips.withColumn("_moves", F.when(F.coalesce(d >= min_distance_m, F.lit(True)), 1).otherwise(0)).withColumn("_dt", F.coalesce(F.col("t_s") - F.lag("t_s").over(w), F.lit(0)))
    p = p.withColumn("_island", F.sum("_moves").over(upto))
    p = p.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("agent_id", "trip_no", "_island")))
    p = p.withColumn("_stay", F.when((F.col("_moves") == 0) & (F.col("_size") > n + 1), 1).otherwise(0))
    p = p.withColumn("_group", F.sum(1 - F.col("_stay")).over(upto))
    g = Window.partitionBy("agent_id", "trip_no", "_group")
    p = p.withColumn("_rest", F.sum(F.col("_dt") * F.col("_stay")).over(g)).withColumn("_last", F.row_number().over(g.orderBy(F.desc("seq"))))
    p = p.where("_last = 1").withColumn("_cut", F.when((F.col("_stay") == 1) & (F.col("_rest") > dwell_s), 1).otherwise(0))
    return p.withColumn("sub_no", F.sum("_cut").over(upto)).drop(*[c for c in p.columns if c.startswith("_")])


def trip_ids(trips: DataFrame, keys: list[str]) -> DataFrame:
    """Adds a global trip_id from 1, in order of ``keys``."""
    return trips.join(number_rows(trips.select(*keys).distinct(), keys, "trip_id", 1), keys)


def waypoint_od(trips: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """keys, o_x, o_y, d_x, d_y, way_points ('x,y;x,y') of trips with two points or more.

    The first, the last and every gap-th point are kept, gap = max(int((n - 2) / k), 1).
    """
    w = Window.partitionBy(*keys).orderBy("seq")
    p = trips.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("_k", F.row_number().over(w)).where("_n >= 2")
    gap = F.greatest(F.floor((F.col("_n") - 2) / k), F.lit(1))
    p = p.where((F.col("_k") == 1) | (F.col("_k") == F.col("_n")) | (F.col("_k") % gap == 0))
    g = p.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "x_m", "y_m"))).alias("e"))
    text = F.transform(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))), lambda q: F.concat_ws(",", q["x_m"].cast("string"), q["y_m"].cast("string")))
    return g.select(*keys, F.col("e")[0]["x_m"].alias("o_x"), F.col("e")[0]["y_m"].alias("o_y"), F.element_at("e", -1)["x_m"].alias("d_x"), F.element_at("e", -1)["y_m"].alias("d_y"), F.concat_ws(";", text).alias("way_points"))


def trip_segmentation(points: DataFrame, gap_s: int = 1800, min_distance_m: float = 10.0, n: int = 5, dwell_s: float = 60.0) -> DataFrame:
    """Points with trip_no, sub_no and a global trip_id, numbered in order of agent, trip and sub-trip: main trips, cut at stays."""
    t = sub_trips(main_trips(points, gap_s), min_distance_m, n, dwell_s)
    return trip_ids(t, ["agent_id", "trip_no", "sub_no"])


def od_by_gps(points: DataFrame, gap_s: int = 1800, min_distance_m: float = 10.0, n: int = 5, dwell_s: float = 60.0, k: int = 5) -> DataFrame:
    """od_id, agent_id, trip_no, sub_no, o_x, o_y, d_x, d_y, way_points, hh of the trips of points.

    ``trip_segmentation``, then ``waypoint_od``; od_id is the trip_id, hh the hour
    of day in which the trip starts.
    """
    t = staged(trip_segmentation(points, gap_s, min_distance_m, n, dwell_s))
    keys = ["trip_id", "agent_id", "trip_no", "sub_no"]
    start = t.groupBy("trip_id").agg(F.floor(F.min("t_s") / 3600 % 24).cast("int").alias("hh"))
    return waypoint_od(t, keys, k).join(start, "trip_id").withColumnRenamed("trip_id", "od_id")


def region_centres(regions: DataFrame) -> DataFrame:
    """region_id, x, y: the mean of the vertices of each area; areas without geometry have no row."""
    v = regions.select("region_id", F.explode(F.flatten(F.flatten(polygon_parts(F.col("geometry"))))).alias("p"))
    return v.groupBy("region_id").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))


def region_od(centres: DataFrame, region: str = "region_id") -> DataFrame:
    """All ordered pairs of different regions: o, d, o_x, o_y, d_x, d_y.

    The result itself is the square of the number of regions.  The origins are
    repartitioned, so that the pairs, which only a nested loop can make, are made
    in parallel against the layer of areas.
    """
    o = centres.select(F.col(region).alias("o"), F.col("x").alias("o_x"), F.col("y").alias("o_y")).repartition("o")
    d = centres.select(F.col(region).alias("d"), F.col("x").alias("d_x"), F.col("y").alias("d_y"))
    return o.join(d, F.col("o") != F.col("d"))


def random_od(spark: SparkSession, regions: DataFrame, n: int, least_m: float, seed: int = 0, snap_deg: float = 1e-4, tries: int = 20_000) -> DataFrame:
    """od_id, o_x, o_y, d_x, d_y of ``n`` pairs of places drawn within the regions, at least ``least_m`` apart.

    A sampling operator: candidates are drawn in the regions' box from a hash of
    seed and number, snapped to a grid of ``snap_deg``, kept if both ends lie in a
    region and are far enough apart, and the first ``n`` are taken.  At most
    ``tries`` candidates a pair asked for are looked at, in rounds that double.
    """
    v = regions.select(F.explode(F.flatten(F.flatten(polygon_parts(F.col("geometry"))))).alias("p"))
    box = v.agg(F.min("p.x").alias("x1"), F.min("p.y").alias("y1"), F.max("p.x").alias("x2"), F.max("p.y").alias("y2")).first()
    schema = "od_id bigint, o_x double, o_y double, d_x double, d_y double"
    if box["x1"] is None or n <= 0:
        return spark.createDataFrame([], schema)

    def lot(k: int, lo: float, hi: float) -> Column:
        u = F.pmod(F.xxhash64("id", F.lit(seed * 4 + k)), F.lit(1 << 40)) / float(1 << 40)
        return F.round((lo + u * (hi - lo)) / snap_deg) * snap_deg

    size = 4 * n
    while True:
        c = spark.range(size).select("id", lot(0, box["x1"], box["x2"]).alias("o_x"), lot(1, box["y1"], box["y2"]).alias("o_y"), lot(2, box["x1"], box["x2"]).alias("d_x"), lot(3, box["y1"], box["y2"]).alias("d_y"))
        c = c.where(great_circle_m(F.col("o_x"), F.col("o_y"), F.col("d_x"), F.col("d_y")) >= least_m)
        for side in ("o", "d"):
            at = c.select("id", F.col(f"{side}_x").alias("lng"), F.col(f"{side}_y").alias("lat"))
            c = c.join(containing_regions(at, regions, "id").select("id").distinct(), "id", "left_semi")
        c = staged(c)
        if size >= tries * n or c.limit(n).count() >= n:
            break
        size *= 4
    first = c.orderBy("id").limit(n)
    return first.select((F.row_number().over(Window.orderBy("id"))).cast("bigint").alias("od_id"), "o_x", "o_y", "d_x", "d_y")


def route_points(routes: DataFrame) -> DataFrame:
    """Timed points of routes: path_id, seq, t_s, x, y.

    ``routes`` has path_id, o_time_s and segments array<struct<time_cost, pts
    array<struct<x,y>>>>; a segment's time is spread over its points by their
    share of its length; repeated times of a path keep their first point.
    """
    seg = routes.select("path_id", "o_time_s", F.posexplode("segments").alias("i", "g"))
    before = Window.partitionBy("path_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_t0", F.col("o_time_s") + F.coalesce(F.sum("g.time_cost").over(before), F.lit(0.0)))
    pts = seg.select("path_id", "i", "_t0", F.col("g.time_cost").alias("cost"), F.posexplode("g.pts").alias("k", "p"))
    w = Window.partitionBy("path_id", "i").orderBy("k")
    d = plane_distance(F.lag("p.x").over(w), F.lag("p.y").over(w), F.col("p.x"), F.col("p.y"))
    pts = pts.withColumn("_d", F.coalesce(d, F.lit(0.0)))
    run, all_ = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_d").over(Window.partitionBy("path_id", "i"))
    pts = pts.withColumn("t_s", F.col("_t0") + F.coalesce(F.try_divide(run, all_), F.lit(0.0)) * F.col("cost"))
    first = F.row_number().over(Window.partitionBy("path_id", "t_s").orderBy("i", "k"))
    pts = pts.withColumn("_first", first).where("_first = 1")
    return pts.select("path_id", (F.row_number().over(Window.partitionBy("path_id").orderBy("i", "k")) - 1).alias("seq"), "t_s", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
