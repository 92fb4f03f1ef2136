"""Map matching with a hidden Markov model over candidate links."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import roads
from trackloom.operators import cleaning, network
from trackloom.operators.cleaning import by_agent, plane_distance
from trackloom.plans.joins import cell_join, fits
from trackloom.plans.stage import staged

#: Directed links up to which the graph is sent to the workers; beyond them costs are relaxed by joins.
GRAPH_ROWS = 2_000_000
#: Segments up to which the links are sent to the workers, too.
SEGMENTS = 100_000
TENTH = Decimal("0.1")


@dataclass(frozen=True)
class Model:
    """Parameters of matching; defaults as is customary for road networks."""

    buffer_m: float = 200.0
    top_k: int = 20
    beta: float = 6.0
    sigma_m: float = 30.0
    dis_para: float = 0.1
    headings: tuple[float, ...] = (1.0, 1.0, 1.0, 0.9, 0.8, 0.7, 0.6, 0.6, 0.5)
    use_heading: bool = True
    omitted_m: float = 6.0
    not_connected: float = 1000.0
    cutoff_m: float = 1200.0
    use_speed: bool = False
    speed_main: float = 1.0
    speed_least: float = 0.1


def link_parts(directed: DataFrame) -> DataFrame:
    """link, from_node, to_node, part, x1, y1, x2, y2, before, length: the segments of each link, its length before them and in all."""
    if "pts" not in directed.columns:
        length = plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
        return directed.select("link", "from_node", "to_node", F.lit(0).alias("part"), "x1", "y1", "x2", "y2", F.lit(0.0).alias("before"), length.alias("length"))
    s = network.segments(directed.select(F.col("link").alias("link_id"), "pts"))
    s = s.select(F.col("link_id").alias("link"), F.col("topo_seq").alias("part"), "x1", "y1", "x2", "y2", (F.col("seg_acc") - F.col("seg_length")).alias("before"), F.max("seg_acc").over(Window.partitionBy("link_id")).alias("length"))
    return directed.select("link", "from_node", "to_node").join(s, "link")


def _middles(directed: DataFrame) -> DataFrame:
    """link, from_node, to_node, x_m, y_m, along_m: the middle of each link along its course."""
    if "pts" not in directed.columns:
        return directed.select("link", "from_node", "to_node", ((F.col("x1") + F.col("x2")) / 2).alias("x_m"), ((F.col("y1") + F.col("y2")) / 2).alias("y_m"), (plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) / 2).alias("along_m"))
    own, half = plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")), F.col("length") / 2
    f = F.coalesce(F.try_divide(half - F.col("before"), own), F.lit(0.0))
    s = link_parts(directed).where(F.col("before") <= half).withColumn("_k", F.row_number().over(Window.partitionBy("link").orderBy(F.desc("part")))).where("_k = 1")
    return s.select("link", "from_node", "to_node", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x_m"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y_m"), half.alias("along_m"))


def candidates(points: DataFrame, directed: DataFrame, m: Model = Model()) -> DataFrame:
    """agent_id, seq, link, from_node, to_node, dist_m, along_m, length, dx, dy: the nearest links of each point.

    ``directed`` has link, from_node, to_node and x1, y1, x2, y2 (straight links)
    or pts, their array<struct<x,y>>.  Segments are spread over the cells their
    box, widened by the buffer, touches; a point has one cell; the exact distance
    decides; a link counts by its nearest segment, of equal ones the first; the
    ``top_k`` nearest links stay, equal ones by link.  along_m is measured along
    the link; dx, dy is the direction of the segment.
    """
    size = m.buffer_m
    cell = lambda c: F.floor(c / size).cast("bigint")
    lo = lambda a, b: cell(F.least(a, b) - size)
    hi = lambda a, b: cell(F.greatest(a, b) + size)
    spread = link_parts(directed).withColumn("cx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2"))))
    spread = spread.withColumn("cy", F.explode(F.sequence(lo(F.col("y1"), F.col("y2")), hi(F.col("y1"), F.col("y2")))))
    p = points.where("x_m is not null and y_m is not null").select("agent_id", "seq", "x_m", "y_m", cell(F.col("x_m")).alias("cx"), cell(F.col("y_m")).alias("cy"))
    j = cell_join(p, spread, ["cx", "cy"])
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = ux * ux + uy * uy
    f = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("x_m") - F.col("x1")) * ux + (F.col("y_m") - F.col("y1")) * uy, n))), F.lit(0.0))
    j = j.withColumn("_f", f).withColumn("dist_m", plane_distance(F.col("x1") + F.col("_f") * ux, F.col("y1") + F.col("_f") * uy, F.col("x_m"), F.col("y_m"))).where(F.col("dist_m") <= size)
    j = j.select("agent_id", "seq", "link", "from_node", "to_node", "part", "dist_m", (F.col("before") + F.col("_f") * F.sqrt(n)).alias("along_m"), "length", ux.alias("dx"), uy.alias("dy"))
    if "pts" in directed.columns:
        nearest = Window.partitionBy("agent_id", "seq", "link").orderBy("dist_m", "part")
        j = j.withColumn("_k", F.row_number().over(nearest)).where("_k = 1").drop("_k")
    j = j.drop("part")
    w = Window.partitionBy("agent_id", "seq").orderBy("dist_m", "link")
    return j.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= m.top_k).drop("_k")


def restricted(c: DataFrame, points: DataFrame, directed: DataFrame) -> DataFrame:
    """Candidates, where points with a node_id have the links at that node instead: both those that leave and those that enter it."""
    known = points.where("node_id is not null").select("agent_id", "seq", "x_m", "y_m", F.col("node_id").cast("bigint").alias("node_id"))
    parts = link_parts(directed)
    at = lambda side: known.join(parts.withColumnRenamed(side, "node_id").withColumn(side, F.col("node_id")), "node_id")
    j = at("from_node").unionByName(at("to_node"))
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    n = ux * ux + uy * uy
    f = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((F.col("x_m") - F.col("x1")) * ux + (F.col("y_m") - F.col("y1")) * uy, n))), F.lit(0.0))
    j = j.withColumn("_f", f).withColumn("dist_m", plane_distance(F.col("x1") + F.col("_f") * ux, F.col("y1") + F.col("_f") * uy, F.col("x_m"), F.col("y_m")))
    j = j.withColumn("along_m", F.col("before") + F.col("_f") * F.sqrt(n)).withColumn("dx", ux).withColumn("dy", uy)
    w = Window.partitionBy("agent_id", "seq", "link").orderBy("dist_m", "part")
    j = j.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(*c.columns)
    return c.join(known.select("agent_id", "seq"), ["agent_id", "seq"], "left_anti").unionByName(j)


def with_state(c: DataFrame) -> DataFrame:
    """Adds state, the candidate's number from 0 in order of link within its point."""
    return c.withColumn("state", F.row_number().over(Window.partitionBy("agent_id", "seq").orderBy("link")) - 1)


def _dijkstra(neighbours: Graph | dict[int, list[tuple[int, float]]], source: int, cutoff: float) -> Iterator[tuple[int, float, list[int]]]:
    """(node, cost, path) in order of cost; of equal costs the path with fewer links, then from the lower node."""
    done: dict[int, int] = {}
    best = {source: (0.0, 0, -1)}
    heap = [(0.0, 0, source, -1)]
    while heap:
        cost, links, node, before = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = before
        path = [node]
        while path[-1] != source:
            path.append(done[path[-1]])
        yield node, cost, path[::-1]
        for to, length in neighbours.get(node, ()):
            c = cost + length
            if c <= cutoff and to not in done and (to not in best or (c, links + 1, node) < best[to]):
                best[to] = (c, links + 1, node)
                heapq.heappush(heap, (c, links + 1, to, node))


class Graph:
    """Directed edges as sorted numpy arrays, sent to the workers once; a node's neighbours become a list when they are asked for."""

    def __init__(self, f: np.ndarray, t: np.ndarray, length: np.ndarray, speed: np.ndarray | None = None) -> None:
        order = np.lexsort((length, t, f))
        self.f, self.t, self.length = f[order], t[order], length[order]
        self.speed = np.full(len(f), np.nan) if speed is None else speed[order]
        self._known: dict[int, list[tuple[int, float]]] = {}

    @classmethod
    def of(cls, edges: DataFrame) -> Graph:
        """From f, t, length and, if there is one, speed; the caller has checked the size."""
        cols = ["f", "t", "length", *(["speed"] if "speed" in edges.columns else [])]
        table = edges.select(F.col("f").cast("bigint"), F.col("t").cast("bigint"), *[F.col(c).cast("double") for c in cols[2:]]).toArrow()
        return cls(*(table.column(c).to_numpy() for c in cols))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_known": {}}

    def _span(self, node: int) -> tuple[int, int]:
        return int(np.searchsorted(self.f, node)), int(np.searchsorted(self.f, node, side="right"))

    def get(self, node: int, _none: tuple = ()) -> list[tuple[int, float]]:
        if node not in self._known:
            i, j = self._span(node)
            self._known[node] = list(zip(self.t[i:j].tolist(), self.length[i:j].tolist()))
        return self._known[node]

    def mean_speed(self, path: list[int]) -> float:
        """By length, over the edges with a speed; not a number if there is none."""
        whole = m = 0.0
        for f, t in zip(path, path[1:]):
            i, j = self._span(f)
            k = i + int(np.searchsorted(self.t[i:j], t))
            if self.speed[k] == self.speed[k]:
                whole, m = whole + self.speed[k] * self.length[k], m + self.length[k]
        return whole / m if m else math.nan


def bounded_paths(edges: DataFrame, cutoff: float, sources: DataFrame | None = None) -> DataFrame:
    """o, d, cost, path of all nodes reachable within ``cutoff`` (inclusive), the source itself left out.

    ``edges`` has f, t, length >= 0.  A graph of at most GRAPH_ROWS edges is sent
    to the workers once and every source searched there; sources are spread over
    the cluster.  A larger one is relaxed by joins, with equal results.
    """
    if not fits(edges, GRAPH_ROWS):
        return relaxed_paths(edges, cutoff, sources)
    shared = edges.sparkSession.sparkContext.broadcast(Graph.of(edges))
    nodes = (sources if sources is not None else edges.select(F.col("f").alias("o"))).select(F.col("o").cast("bigint")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, d, c, p) for o in b["o"] for d, c, p in _dijkstra(shared.value, o, cutoff) if d != o]
            yield pd.DataFrame(rows, columns=["o", "d", "cost", "path"])

    return nodes.repartition("o").mapInPandas(run, "o bigint, d bigint, cost double, path array<bigint>")


def relaxed_paths(edges: DataFrame, cutoff: float, sources: DataFrame | None = None) -> DataFrame:
    """o, d, cost, path as ``bounded_paths``, for graphs of any size: rounds of joins and minima, each staged.

    Paths are compared from their end, so that the least one is that of
    ``_dijkstra``: least cost, fewest links, lowest node before, and so on.
    """
    big = lambda c: F.col(c).cast("bigint").alias(c)
    e = staged(edges.where("f != t").groupBy(big("f"), big("t")).agg(F.min("length").alias("length")))
    start = e if sources is None else e.join(sources.select(F.col("o").alias("f")).distinct(), "f", "left_semi")
    way = lambda cost, turned: F.struct(cost.cast("double").alias("cost"), F.size(turned).alias("n"), turned.alias("turned"))
    known = front = staged(start.where(F.col("length") <= cutoff).select(F.col("f").alias("o"), F.col("t").alias("d"), way(F.col("length"), F.array("t", "f")).alias("w")))
    while front.limit(1).count():
        step = front.join(e.withColumnRenamed("f", "d"), "d").where((F.col("w.cost") + F.col("length") <= cutoff) & (F.col("o") != F.col("t")))
        further = step.select("o", F.col("t").alias("d"), way(F.col("w.cost") + F.col("length"), F.concat(F.array("t"), "w.turned")).alias("w"))
        both = known.withColumn("new", F.lit(False)).unionByName(further.withColumn("new", F.lit(True))).groupBy("o", "d").agg(F.min(F.struct("w", "new")).alias("m"))
        known = staged(both.select("o", "d", "m.w", "m.new"))
        front = known.where("new").drop("new")
        known = known.drop("new")
    return known.select("o", "d", "w.cost", F.reverse("w.turned").alias("path"))


def with_long_links(paths: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``paths`` and, where it has none from ``sources``, single links of any length as paths of their own."""
    e = edges.select(F.col("f").cast("bigint").alias("o"), F.col("t").cast("bigint").alias("d"), "length").where("o != d")
    if sources is not None:
        e = e.join(sources.select(F.col("o").cast("bigint")).distinct(), "o", "left_semi")
    e = e.groupBy("o", "d").agg(F.min("length").cast("double").alias("cost")).withColumn("path", F.array("o", "d"))
    return paths.unionByName(e.join(paths.select("o", "d"), ["o", "d"], "left_anti"))


def _paths_to(neighbours: Graph, source: int, ends: set[int], cutoff: float) -> Iterator[tuple[int, float, list[int]]]:
    """(node, cost, path) of ``_dijkstra`` for the nodes in ``ends`` alone; the search stops when none of them is left."""
    left = set(ends)
    done: dict[int, int] = {}
    best = {source: (0.0, 0, -1)}
    heap = [(0.0, 0, source, -1)]
    while heap and left:
        cost, links, node, before = heapq.heappop(heap)
        if node in done:
            continue
        done[node] = before
        if node in left:
            left.discard(node)
            path = [node]
            while path[-1] != source:
                path.append(done[path[-1]])
            yield node, cost, path[::-1]
        for to, length in neighbours.get(node, ()):
            c = cost + length
            if c <= cutoff and to not in done and (to not in best or (c, links + 1, node) < best[to]):
                best[to] = (c, links + 1, node)
                heapq.heappush(heap, (c, links + 1, to, node))


def pair_paths(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """o, d, cost, path of the given pairs, however long; pairs that aren't connected have no row.

    A column most of ``pairs`` tells up to which cost a pair's path is wanted;
    one that costs more may be left out.
    """
    most = F.col("most").cast("double") if "most" in pairs.columns else F.lit(math.inf)
    pairs = staged(pairs.select(F.col("o").cast("bigint"), F.col("d").cast("bigint"), most.alias("most")).where("o != d").groupBy("o", "d").agg(F.max("most").alias("most")))
    if not fits(edges, GRAPH_ROWS):
        return relaxed_paths(edges, math.inf, pairs).join(pairs, ["o", "d"], "left_semi")
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(Graph.of(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, d, c, p) for o, ends, most in zip(b["o"], b["ends"], b["most"]) for d, c, p in _paths_to(shared.value, o, set(ends), most)]
            yield pd.DataFrame(rows, columns=["o", "d", "cost", "path"])

    # few rows with much work: a number keeps them apart; a source has at most as many ends as there are nodes
    apart = pairs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o")
    return apart.groupBy("o").agg(F.collect_set("d").alias("ends"), F.max("most").alias("most")).mapInPandas(run, "o bigint, d bigint, cost double, path array<bigint>")


def link_edges(directed: DataFrame) -> DataFrame:
    """f, t, length of directed links, along their course if they bend."""
    length = network.line_length(F.col("pts")) if "pts" in directed.columns else plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    speed = ["speed"] if "speed" in directed.columns else []
    return directed.select(F.col("from_node").alias("f"), F.col("to_node").alias("t"), length.alias("length"), *speed)


def relaxed_costs(edges: DataFrame, cutoff: float, sources: DataFrame | None = None) -> DataFrame:
    """o, d, cost of ``relaxed_paths``."""
    return relaxed_paths(edges, cutoff, sources).drop("path")


def emission(c: DataFrame, points: DataFrame, m: Model = Model()) -> DataFrame:
    """Adds emission: log of the heading factor less half the squared, scaled distance.

    The heading is that of the way from the previous to the next point; a way of
    at most ``omitted_m`` tells nothing.
    """
    w = by_agent()
    diff = lambda a: F.coalesce(F.lead(a).over(w), F.col(a)) - F.coalesce(F.lag(a).over(w), F.col(a))
    vec = points.select("agent_id", "seq", diff("x_m").alias("gx"), diff("y_m").alias("gy"))
    j = c.join(vec, ["agent_id", "seq"])
    lengths = F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) * F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    cos = F.try_divide(F.col("gx") * F.col("dx") + F.col("gy") * F.col("dy"), lengths)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    usable = F.lit(m.use_heading) & (F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2) > m.omitted_m)
    off = F.when(usable, F.least(F.coalesce(angle, F.lit(0.0)), F.lit(179.9))).otherwise(0.0)
    factor = F.element_at(F.array(*[F.lit(h) for h in m.headings]), F.floor(off / (180.0 / len(m.headings))).cast("int") + 1)
    return j.withColumn("emission", F.log(factor) - 0.5 * F.pow(m.dis_para * F.col("dist_m") / m.sigma_m, 2)).drop("gx", "gy")


def transitions(c: DataFrame, points: DataFrame, paths: DataFrame, m: Model = Model()) -> DataFrame:
    """agent_id, seq, i, j, valid, route_m, log_p between the states of a point and the next one with candidates.

    A route leads along the first link, by the cached path between the links'
    first nodes, onto the second.  It is valid on the same link, between
    opposite links, or if the path begins with the first link and doesn't turn
    back over the second; others get the length for unconnected links.  Links
    longer than the cutoff of the paths must be among these as paths of their own.
    """
    with_cands = c.select("agent_id", "seq").distinct()
    nxt = F.lead("seq").over(by_agent())
    step = with_cands.withColumn("next_seq", nxt).where("next_seq is not null")
    where = points.select("agent_id", "seq", "x_m", "y_m", F.col("t_s") if m.use_speed else F.lit(0).alias("t_s"))
    step = step.join(where, ["agent_id", "seq"]).join(where.select("agent_id", F.col("seq").alias("next_seq"), F.col("x_m").alias("nx"), F.col("y_m").alias("ny"), F.col("t_s").alias("nt")), ["agent_id", "next_seq"])
    gps = plane_distance(F.col("x_m"), F.col("y_m"), F.col("nx"), F.col("ny"))
    step = step.select("agent_id", "seq", "next_seq", gps.alias("gps_m"), F.coalesce(F.try_divide(gps * 3.6, F.col("nt") - F.col("t_s")), F.lit(math.inf)).alias("gps_kmh"))
    a = c.select("agent_id", "seq", F.col("state").alias("i"), F.col("link").alias("la"), F.col("from_node").alias("fa"), F.col("to_node").alias("ta"), F.col("along_m").alias("ra"))
    b = c.select("agent_id", F.col("seq").alias("next_seq"), F.col("state").alias("j"), F.col("link").alias("lb"), F.col("from_node").alias("fb"), F.col("to_node").alias("tb"), F.col("along_m").alias("rb"))
    # at most top_k squared rows a point
    t = step.join(a, ["agent_id", "seq"]).join(b, ["agent_id", "next_seq"])
    p = paths.select(F.col("o").alias("fa"), F.col("d").alias("fb"), F.bround("cost", 1).alias("cost"), F.col("path")[1].alias("second"), F.element_at("path", -2).alias("last_but_one"), (F.col("road_kmh") if "road_kmh" in paths.columns else F.lit(None).cast("double")).alias("road_kmh"))
    t = t.join(p, ["fa", "fb"], "left")
    same, opposite = F.col("la") == F.col("lb"), (F.col("fa") == F.col("tb")) & (F.col("ta") == F.col("fb"))
    valid = same | opposite | F.coalesce((F.col("cost") > 0) & (F.col("second") == F.col("ta")) & (F.col("last_but_one") != F.col("tb")), F.lit(False))
    route = F.when(valid, F.abs(F.coalesce(F.col("cost"), F.lit(0.0)) - F.col("ra") + F.col("rb"))).otherwise(m.not_connected)
    t = t.withColumn("valid", valid).withColumn("route_m", route)
    gap = F.when(F.col("valid"), F.abs(F.col("gps_m") - F.col("route_m"))).otherwise(m.not_connected)
    log_p = gap * (-m.dis_para / m.beta)
    if m.use_speed:
        log_p = log_p + F.log(speed_factor(F.col("gps_kmh"), F.col("road_kmh"), F.col("valid"), m.speed_main, m.speed_least))
    return t.select("agent_id", "seq", "i", "j", "valid", "route_m", log_p.alias("log_p"))


def with_road_speed(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds road_kmh: the mean speed of a path's edges by length, null speeds left out."""
    legs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("f"), b.alias("t")))
    e = edges.groupBy(F.col("f").cast("bigint").alias("f"), F.col("t").cast("bigint").alias("t")).agg(F.min(F.struct("length", "speed")).alias("e")).select("f", "t", "e.*")
    mean = network.weighted_speed(paths.select("o", "d", F.explode(legs).alias("l")).select("o", "d", "l.*").join(e, ["f", "t"]), ["o", "d"])
    return paths.join(mean.withColumnRenamed("mean_speed", "road_kmh"), ["o", "d"], "left")


def speed_factor(speed: Column, road: Column, valid: Column, main: float = 1.0, least: float = 0.1) -> Column:
    """Factor for a way driven at ``speed`` over roads of mean speed ``road``."""
    slow = main * F.greatest(1 - (speed - road) / road, F.lit(least))
    return F.when(road.isNull(), F.when(valid, 1.0).otherwise(main * least)).otherwise(F.when(speed <= road, 1.0).otherwise(slow))


def viterbi(emissions: list[np.ndarray], moves: list[np.ndarray]) -> tuple[list[int], float]:
    """Most probable states and their score; of equal ways the lowest state."""
    z = emissions[0] - math.log(len(emissions[0]))
    back = []
    for e, a in zip(emissions[1:], moves):
        total = z[:, None] + a
        k = total.argmax(axis=0)
        back.append(k)
        z = total[k, np.arange(len(e))] + e
    s = [int(z.argmax())]
    for k in reversed(back):
        s.append(int(k[s[-1]]))
    return s[::-1], float(z.max())


def decode(c: DataFrame, t: DataFrame) -> DataFrame:
    """agent_id, seq, state, route_m (to the next matched point), valid of the best sequence of each agent.

    Candidates and moves of an agent reach one worker as sorted rows and are
    decoded step by step; partitions hold many agents.  Agents with a single
    matchable point keep their best candidate.
    """
    rows = c.select("agent_id", "seq", F.lit(0).alias("kind"), F.col("state").alias("i"), F.lit(0).alias("j"), F.col("emission").alias("v"), F.lit(0.0).alias("r"), F.lit(True).alias("ok"))
    rows = rows.unionByName(t.select("agent_id", "seq", F.lit(1).alias("kind"), "i", "j", F.col("log_p").alias("v"), F.col("route_m").alias("r"), F.col("valid").alias("ok")))
    kind = dict(c.dtypes)["agent_id"]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        e = g[g["kind"] == 0]
        seqs, first = np.unique(e["seq"].to_numpy(), return_index=True)
        ems = np.split(e["v"].to_numpy(), first[1:])
        mv = g[g["kind"] == 1]
        ms, starts = np.unique(mv["seq"].to_numpy(), return_index=True)
        step = {s: (v, r, k) for s, v, r, k in zip(ms, *(np.split(mv[c].to_numpy(), starts[1:]) for c in ("v", "r", "ok")))}
        shape = [(len(a), len(b)) for a, b in zip(ems, ems[1:])]
        best, _ = viterbi(ems, [step[s][0].reshape(n) for s, n in zip(seqs, shape)])
        route = [step[s][1].reshape(n)[i, j] for s, n, i, j in zip(seqs, shape, best, best[1:])]
        ok = [bool(step[s][2].reshape(n)[i, j]) for s, n, i, j in zip(seqs, shape, best, best[1:])]
        return pd.DataFrame({"agent_id": g["agent_id"].iloc[0], "seq": seqs, "state": best, "route_m": [*route, None], "valid": [*ok, None]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for b in batches:
            for agent, g in b.groupby("agent_id", sort=False):
                if rest and rest[0]["agent_id"].iloc[0] != agent:
                    yield one(pd.concat(rest))
                    rest = []
                rest.append(g)
        if rest:
            yield one(pd.concat(rest))

    return rows.repartition("agent_id").sortWithinPartitions("agent_id", "kind", "seq", "i", "j").mapInPandas(run, f"agent_id {kind}, seq bigint, state int, route_m double, valid boolean")


def _tenth(c: float) -> float:
    """Rounded to a tenth as ``bround`` does, by the number's decimal notation; only near ties that takes decimals."""
    if abs(c * 10 % 1 - 0.5) > 1e-6:
        return round(c, 1)
    return float(Decimal(repr(c)).quantize(TENTH, ROUND_HALF_EVEN))


class Moves:
    """Transitions between the candidates of two points, on a shared graph whose bounded paths are searched once a source and worker."""

    def __init__(self, graph: Graph, m: Model) -> None:
        self.graph, self.m = graph, m
        self.known: dict[int, dict[int, tuple[float, int, int, float]]] = {}
        self.held = 0

    def paths(self, o: int) -> dict[int, tuple[float, int, int, float]]:
        """By end: cost to a tenth of a metre, second and last but one node, mean speed."""
        if o not in self.known:
            # a bound on memory, not on what is found
            if self.held > 5_000_000:
                self.known, self.held = {}, 0
            self.known[o] = self.search(o)
            self.held += len(self.known[o])
        return self.known[o]

    def search(self, o: int) -> dict[int, tuple[float, int, int, float]]:
        """``paths``, not kept."""
        if self.m.use_speed:
            found = {d: (_tenth(c), p[1], p[-2], self.graph.mean_speed(p)) for d, c, p in _dijkstra(self.graph, o, self.m.cutoff_m) if d != o}
        else:
            found = self._ends(o)
        for d, c in self.graph.get(o):
            if d != o and d not in found:
                found[d] = (_tenth(c), d, o, self.graph.mean_speed([o, d]) if self.m.use_speed else math.nan)
        return found

    def _ends(self, o: int) -> dict[int, tuple[float, int, int, float]]:
        """The search of ``_dijkstra``, of whose paths only the second and last but one node are kept."""
        cutoff, neighbours = self.m.cutoff_m, self.graph.get
        second: dict[int, int] = {}
        found: dict[int, tuple[float, int, int, float]] = {}
        best = {o: (0.0, 0, -1)}
        heap = [(0.0, 0, o, -1)]
        while heap:
            cost, links, node, before = heapq.heappop(heap)
            if node in second:
                continue
            second[node] = node if before in (-1, o) else second[before]
            if node != o:
                found[node] = (_tenth(cost), second[node], before, math.nan)
            for to, length in neighbours(node):
                c = cost + length
                if c <= cutoff and to not in second and (to not in best or (c, links + 1, node) < best[to]):
                    best[to] = (c, links + 1, node)
                    heapq.heappush(heap, (c, links + 1, to, node))
        return found

    def between(self, a: dict[str, np.ndarray], b: dict[str, np.ndarray], gps_m: float, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probability, route, valid) for each pair of candidates."""
        none = (math.nan, -1, -1, math.nan)
        ends = b["from_node"].tolist()
        cost, second, before, road = np.array([[found.get(d, none) for d in ends] for found in map(self.paths, a["from_node"].tolist())], dtype=float).transpose(2, 0, 1)
        with np.errstate(invalid="ignore", divide="ignore"):
            on = (cost > 0) & (second == a["to_node"][:, None]) & (before != b["to_node"])
            same = a["link"][:, None] == b["link"]
            opposite = (a["from_node"][:, None] == b["to_node"]) & (a["to_node"][:, None] == b["from_node"])
            valid = on | same | opposite
            route = np.where(valid, np.abs(np.nan_to_num(cost) - a["along_m"][:, None] + b["along_m"]), self.m.not_connected)
            gap = np.where(valid, np.abs(gps_m - route), self.m.not_connected)
            log_p = gap * (-self.m.dis_para / self.m.beta)
            if self.m.use_speed:
                kmh = gps_m * 3.6 / dt if dt else math.inf
                main, least = self.m.speed_main, self.m.speed_least
                known = np.where(kmh <= road, 1.0, main * np.maximum(1 - (kmh - road) / road, least))
                log_p = log_p + np.log(np.where(np.isnan(road), np.where(valid, 1.0, main * least), known))
        return log_p, route, valid


def decode_shared(c: DataFrame, points: DataFrame, edges: DataFrame, m: Model = Model()) -> DataFrame:
    """As ``decode`` of ``transitions``, on a graph that is sent to the workers.

    Candidates reach a worker sorted by agent and point and are folded point by
    point: of the past only the scores of the last point and, for each point, the
    places of its predecessors are held, so moves are never rows.
    """
    shared = edges.sparkSession.sparkContext.broadcast(Graph.of(edges))
    names = ["link", "from_node", "to_node", "along_m", "emission", "x_m", "y_m", "t_s"]
    at = points.select("agent_id", "seq", "x_m", "y_m", (F.col("t_s") if "t_s" in points.columns else F.lit(0)).cast("double").alias("t_s"))
    rows = c.select("agent_id", "seq", "state", *names[:5]).join(at, ["agent_id", "seq"])
    kind = dict(c.dtypes)["agent_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        moves = Moves(shared.value, m)
        agent, last, z = None, None, np.zeros(0)
        trail: list[tuple] = []  # (seq, places before, routes, validity) of each point

        def flushed() -> pd.DataFrame:
            best = [int(z.argmax())]
            for _, back, *_ in trail[:0:-1]:
                best.append(int(back[best[-1]]))
            best.reverse()
            route = [float(r[i, j]) for (_, _, r, _), i, j in zip(trail[1:], best, best[1:])]
            ok = [bool(v[i, j]) for (_, _, _, v), i, j in zip(trail[1:], best, best[1:])]
            return pd.DataFrame({"agent_id": agent, "seq": [x[0] for x in trail], "state": best, "route_m": [*route, None], "valid": [*ok, None]})

        rest: pd.DataFrame | None = None
        for b in chain(batches, [None]):
            if b is None:
                g, whole = rest, True
            else:
                g, whole = (b if rest is None else pd.concat([rest, b], ignore_index=True)), False
            if g is None or not len(g):
                continue
            who, seq = g["agent_id"].to_numpy(), g["seq"].to_numpy()
            edge = np.flatnonzero((who[1:] != who[:-1]) | (seq[1:] != seq[:-1])) + 1
            starts = np.concatenate([[0], edge])
            ends = np.append(edge, len(g))
            # the last point may go on in the next batch
            rest = None if whole else g.iloc[starts[-1] :]
            cols = {n: g[n].to_numpy() for n in names}
            for i, j in list(zip(starts, ends))[: None if whole else -1]:
                here = {n: v[i:j] for n, v in cols.items()}
                if trail and who[i] == agent:
                    gps = math.hypot(here["x_m"][0] - last["x_m"][0], here["y_m"][0] - last["y_m"][0])
                    log_p, route, ok = moves.between(last, here, gps, here["t_s"][0] - last["t_s"][0])
                    total = z[:, None] + log_p
                    back = total.argmax(axis=0)
                    z = total[back, np.arange(j - i)] + here["emission"]
                    trail.append((seq[i], back.astype(np.int16), route.astype(np.float64), ok))
                else:
                    if trail:
                        yield flushed()
                    agent, trail, z = who[i], [(seq[i], None, None, None)], here["emission"] - math.log(j - i)
                last = here
        if trail:
            yield flushed()

    return rows.repartition("agent_id").sortWithinPartitions("agent_id", "seq", "state").mapInPandas(run, f"agent_id {kind}, seq bigint, state int, route_m double, valid boolean")


def _whole(points: DataFrame, parts: DataFrame, edges: DataFrame, m: Model, steps: bool) -> DataFrame:
    """``match`` or, with ``steps``, ``gaps`` with segments and graph sent to the workers: a point and its match are the only rows.

    Points reach a worker by agent and in order; agents are matched many at a
    time, an agent of any length in pieces.
    """
    heading = F.round(F.pmod(F.degrees(F.atan2(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), F.lit(360.0)), 2)
    big, real = ["link", "from_node", "to_node"], ["x1", "y1", "x2", "y2", "before", "length"]
    table = parts.select(*[F.col(c).cast("bigint") for c in [*big, "part"]], *[F.col(c).cast("double") for c in real], heading.alias("heading")).toArrow()
    graph = Graph.of(edges)
    links = roads.Roads({c: table.column(c).to_numpy() for c in table.column_names}, np.concatenate([graph.f, graph.t]))
    shared = edges.sparkSession.sparkContext.broadcast((graph, links))
    kinds = dict(points.dtypes)
    # the window brings agents together and in order; points that are so already aren't shuffled again
    own = points.select("agent_id", F.col("seq").cast("bigint").alias("seq"), F.col("x_m").cast("double").alias("x_m"), F.col("y_m").cast("double").alias("y_m"), *(["t_s"] if steps else []), F.row_number().over(by_agent()).alias("_k"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, r = shared.value
        matcher = roads.Matcher(r, Moves(graph, m).search, m)

        def found(g: pd.DataFrame, agent: np.ndarray) -> pd.DataFrame:
            got = matcher.match(agent, g["x_m"].to_numpy(), g["y_m"].to_numpy())
            row, link = got["row"], r.seg_link[got["seg"]]
            on = np.append(agent[row][1:] == agent[row][:-1], False) if len(row) else np.zeros(0, bool)
            who, seq, f, t = g["agent_id"].to_numpy()[row], g["seq"].to_numpy()[row], r.from_node[link], r.to_node[link]
            if steps:
                i = np.flatnonzero(on)
                i = i[~((f[i] == f[i + 1]) & (t[i] == t[i + 1])) & (t[i] != f[i + 1])]
                s = g["t_s"].to_numpy()[row]
                return pd.DataFrame({"agent_id": who[i], "seq": seq[i], "t_s": s[i], "to_node": t[i], "_d": f[i + 1], "t2": s[i + 1]})
            return pd.DataFrame({"agent_id": who, "seq": seq, "link": r.link[link], "from_node": f, "to_node": t, "dist_m": got["dist"], "along_m": got["along"], "heading": r.heading[got["seg"]], "route_m": pd.Series(got["route"]).where(on), "valid": pd.Series(got["valid"], dtype=object).where(on, None)})

        held: list[pd.DataFrame] = []
        rows, wanted = 0, roads.POINTS
        for b in chain(batches, [None]):
            if b is not None and len(b):
                held.append(b)
                rows += len(b)
            if not rows or (b is not None and rows < wanted):
                continue
            g = pd.concat(held, ignore_index=True)
            who = g["agent_id"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero(who[1:] != who[:-1]) + 1, [rows]])
            # the last agent may go on in the next batch
            upto = len(first) - (1 if b is None else 2)
            a = 0
            while a < upto:
                z = a + 1
                while z < upto and first[z + 1] - first[a] <= 2 * roads.POINTS:
                    z += 1
                part = g.iloc[first[a] : first[z]].reset_index(drop=True)
                yield found(part, np.repeat(np.arange(z - a), np.diff(first[a : z + 1])))
                a = z
            held = [g.iloc[first[a] :]]
            rows = len(held[0])
            wanted = max(roads.POINTS, 2 * rows)

    agent = kinds["agent_id"]
    out = f"agent_id {agent}, seq bigint, t_s {kinds['t_s']}, to_node bigint, _d bigint, t2 {kinds['t_s']}" if steps else f"agent_id {agent}, seq bigint, link bigint, from_node bigint, to_node bigint, dist_m double, along_m double, heading double, route_m double, valid boolean"
    return own.mapInPandas(run, out)


def _sent(parts: DataFrame, edges: DataFrame, m: Model) -> bool:
    """Whether links and graph are of a size to be sent to the workers; speeds are only looked at with the candidates in rows."""
    return not m.use_speed and fits(edges, GRAPH_ROWS) and fits(parts, SEGMENTS)


def gaps(points: DataFrame, directed: DataFrame, m: Model = Model()) -> DataFrame:
    """agent_id, seq, t_s, to_node, _d, t2: the steps of ``match`` between links that don't touch, from to_node to _d."""
    parts, edges = staged(link_parts(directed)), link_edges(directed)
    if _sent(parts, edges, m):
        return _whole(points, parts, edges, m, True)
    points = staged(points)
    return open_steps(match(points, directed, m), points)


def match(points: DataFrame, directed: DataFrame, m: Model = Model(), nodes: bool = False) -> DataFrame:
    """agent_id, seq, link, from_node, to_node, dist_m, along_m, heading, route_m, valid, loc_type of every matchable point.

    route_m and valid are those of the way to the agent's next matched point, null
    at its last one.  With ``nodes`` the points' node_id restricts their
    candidates.  On networks of up to SEGMENTS segments candidates are sought where
    the sequences are decoded.  Beyond that they are joined; up to GRAPH_ROWS
    directed links sequences are then decoded on a shared graph, beyond that paths
    and transitions are joined.  All ways give the same.
    """
    if not nodes:
        parts, edges = staged(link_parts(directed)), link_edges(directed)
        if _sent(parts, edges, m):
            return _whole(points, parts, edges, m, False).withColumn("loc_type", F.lit("s"))
        points = staged(points)
    c = candidates(points, directed, m)
    if nodes:
        c = restricted(c, points, directed)
    c = staged(emission(with_state(c), points, m))
    edges = link_edges(directed)
    if fits(edges, GRAPH_ROWS):
        best = decode_shared(c, points, edges, m)
    else:
        starts = c.select(F.col("from_node").alias("o")).distinct()
        paths = with_long_links(staged(bounded_paths(edges, m.cutoff_m, starts)), edges, starts)
        if m.use_speed and "speed" in edges.columns:
            paths = with_road_speed(paths, edges)
        best = decode(c, transitions(c, points, paths, m))
    heading = F.pmod(F.degrees(F.atan2("dx", "dy")), F.lit(360.0))
    return best.join(c, ["agent_id", "seq", "state"]).select("agent_id", "seq", "link", "from_node", "to_node", "dist_m", "along_m", F.round(heading, 2).alias("heading"), "route_m", "valid", F.lit("s").alias("loc_type"))


def warnings(matched: DataFrame) -> DataFrame:
    """agent_id, seq, next_seq, link, from_node, to_node, next_link, next_from, next_to: steps whose links aren't connected."""
    n = F.lead(F.struct("seq", "link", "from_node", "to_node")).over(by_agent())
    return matched.withColumn("_n", n).where("valid = false").select("agent_id", "seq", F.col("_n.seq").alias("next_seq"), "link", "from_node", "to_node", F.col("_n.link").alias("next_link"), F.col("_n.from_node").alias("next_from"), F.col("_n.to_node").alias("next_to"))


def warning_lines(warned: DataFrame, directed: DataFrame) -> DataFrame:
    """agent_id, seq, part ('from' or 'to'), link, pts: the links of each warning as lines."""
    own = F.col("pts") if "pts" in directed.columns else F.array(F.struct(F.col("x1").cast("double").alias("x"), F.col("y1").cast("double").alias("y")), F.struct(F.col("x2").cast("double").alias("x"), F.col("y2").cast("double").alias("y")))
    parts = warned.select("agent_id", "seq", F.explode(F.array(F.struct(F.lit("from").alias("part"), "link"), F.struct(F.lit("to").alias("part"), F.col("next_link").alias("link")))).alias("w")).select("agent_id", "seq", "w.*")
    return parts.join(directed.select("link", own.alias("pts")), "link").select("agent_id", "seq", "part", "link", "pts")


@dataclass(frozen=True)
class Cleaning:
    """What is done to points before they are matched; None leaves a step out."""

    dwell_m: float | None = None
    dwell_n: int = 2
    every: int | None = None
    window: int | None = None
    dense_m: float | None = None


def match_batch(points: DataFrame, directed: DataFrame, m: Model = Model(), clean: Cleaning = Cleaning(), nodes: bool = False) -> dict[str, DataFrame]:
    """matched, completed, warnings and errors of a table of trajectories.

    Points are cleaned in the order dwell, lower frequency, rolling mean, added
    points; then matched, and links between matched ones filled in.  errors has a
    row (agent_id, reason) for every agent without a match; no agent stops others.
    """
    p = points
    if clean.dwell_m is not None:
        p = cleaning.remove_dwell(p, clean.dwell_m, clean.dwell_n)
    if clean.every is not None:
        p = cleaning.lower_frequency(p, clean.every)
    if clean.window is not None:
        p = cleaning.rolling_average(p, clean.window)
    if clean.dense_m is not None:
        p = cleaning.densify(p, clean.dense_m)
    p = staged(p)
    matched = staged(match(p, directed, m, nodes))
    edges = link_edges(directed)
    ends = matched.select(F.col("to_node").alias("o")).distinct()
    paths = staged(bounded_paths(edges, m.cutoff_m, ends))
    n = matched.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"))
    everyone = points.select("agent_id").distinct().join(n, "agent_id", "left")
    errors = everyone.where("n is null or n < 2").select("agent_id", F.when(F.col("n").isNull(), "no point near a link").otherwise("a single point near a link").alias("reason"))
    return {"matched": matched, "completed": completed(matched, p, paths, directed), "warnings": warnings(matched), "errors": errors}


def best_of(points: DataFrame, directed: DataFrame, models: list[Model]) -> DataFrame:
    """``match`` under the first of ``models`` that leaves an agent without warnings, or the last one; adds model, its number from 0.

    Agents that are done drop out before the next model is tried.
    """
    left, found = points, None
    for k, m in enumerate(models):
        got = staged(match(left, directed, m).withColumn("model", F.lit(k)))
        bad = warnings(got).select("agent_id").distinct()
        last = k == len(models) - 1
        done = got if last else got.join(bad, "agent_id", "left_anti")
        found = done if found is None else found.unionByName(done)
        left = staged(left.join(bad, "agent_id", "left_semi"))
        if not last and not left.limit(1).count():
            break
    return found


def dense_result(matched: DataFrame, points: DataFrame, directed: DataFrame, least_m: float = 3.0) -> DataFrame:
    """agent_id, k, t_s, link, x_m, y_m: the matched places and the vertices of their links in order of the way.

    A run of points on one link gets the link's vertices between its first and
    last place, a run that is followed by another one those up to the link's end,
    one that follows another those from its beginning.  Places nearer than
    ``least_m`` to the next one are left out, but for an agent's last one.  Times
    of vertices are filled in between those of the points.
    """
    m = cleaning.run_ids(matched.join(points.select("agent_id", "seq", "t_s"), ["agent_id", "seq"]), ["agent_id"], ["seq"], ["link"])
    parts = staged(link_parts(directed))
    last_run = Window.partitionBy("agent_id")
    runs = m.groupBy("agent_id", "run", "link").agg(F.min("along_m").alias("a"), F.max("along_m").alias("z")).withColumn("_runs", F.max("run").over(last_run))
    lo, hi = F.when(F.col("run") == 1, F.col("a")).otherwise(F.lit(-1.0)), F.when(F.col("run") == F.col("_runs"), F.col("z")).otherwise(F.lit(math.inf))
    ends = parts.select("link", F.explode(F.array(F.struct(F.col("before").alias("along_m"), F.col("x1").alias("x_m"), F.col("y1").alias("y_m")), F.struct((F.col("before") + plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("along_m"), F.col("x2").alias("x_m"), F.col("y2").alias("y_m")))).alias("v")).select("link", "v.*").distinct()
    vertices = runs.withColumn("_lo", lo).withColumn("_hi", hi).join(ends, "link").where("along_m > _lo and along_m < _hi").select("agent_id", "run", "link", "along_m", "x_m", "y_m", F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("double").alias("t_s"))
    own = plane_distance(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    f = F.coalesce(F.try_divide(F.col("along_m") - F.col("before"), own), F.lit(0.0))
    first = Window.partitionBy("agent_id", "seq").orderBy("part")
    places = m.join(parts.select("link", "part", "x1", "y1", "x2", "y2", "before"), "link").where((F.col("along_m") >= F.col("before") - 1e-6) & (F.col("along_m") <= F.col("before") + own + 1e-6)).withColumn("_k", F.row_number().over(first)).where("_k = 1")
    places = places.select("agent_id", "run", "link", "along_m", (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("x_m"), (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("y_m"), F.col("seq").cast("bigint").alias("seq"), F.col("t_s").cast("double").alias("t_s"))
    order = Window.partitionBy("agent_id").orderBy("run", "along_m", F.col("seq").asc_nulls_last())
    all_ = places.unionByName(vertices).withColumn("k", F.row_number().over(order))
    nxt = F.lead(F.struct("x_m", "y_m")).over(Window.partitionBy("agent_id").orderBy("k"))
    kept = all_.withColumn("_n", nxt).where(F.col("_n").isNull() | (plane_distance(F.col("x_m"), F.col("y_m"), F.col("_n.x_m"), F.col("_n.y_m")) > least_m)).drop("_n")
    filled = cleaning.gap_fill(kept, ["agent_id"], "k", "t_s")
    return filled.select("agent_id", (F.row_number().over(Window.partitionBy("agent_id").orderBy("k")) - 1).alias("k"), "t_s", "link", "x_m", "y_m")


def path_table(edges: DataFrame, cutoff: float, table: str, sources: DataFrame | None = None) -> DataFrame:
    """The bounded paths kept in a table at a path: only sources it doesn't hold are searched, and appended.

    o, d, cost (to a tenth), path, second, last_but_one, source rows of single
    links of any length included.  Losing an executor loses nothing of the table.
    """
    spark = edges.sparkSession
    nodes = (sources if sources is not None else edges.select(F.col("f").alias("o"))).select(F.col("o").cast("bigint").alias("o")).distinct()
    try:
        old = spark.read.parquet(table)
        nodes = staged(nodes.join(old.select("o").distinct(), "o", "left_anti"))
    except AnalysisException:
        nodes = staged(nodes)
    if nodes.limit(1).count():
        new = with_long_links(bounded_paths(edges, cutoff, nodes), edges, nodes)
        new.select("o", "d", F.bround("cost", 1).alias("cost"), "path", F.col("path")[1].alias("second"), F.element_at("path", -2).alias("last_but_one")).write.mode("append").parquet(table)
    return spark.read.parquet(table)


def od_paths(edges: DataFrame, pairs: DataFrame, not_connected: float | None = None) -> DataFrame:
    """o, d, cost, path of every given pair, however long; unreachable ones have ``not_connected`` and an empty path, and a node itself costs 0."""
    p = pairs.select(F.col("o").cast("bigint"), F.col("d").cast("bigint")).distinct()
    found = p.join(pair_paths(edges, p), ["o", "d"], "left")
    own = F.col("o") == F.col("d")
    return found.select("o", "d", F.when(own, 0.0).otherwise(F.coalesce("cost", F.lit(not_connected).cast("double"))).alias("cost"), F.when(own, F.array("o")).otherwise(F.coalesce("path", F.array().cast("array<bigint>"))).alias("path"))


def random_paths(edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """o, d, cost, path of ``n`` pairs of nodes drawn by a seeded hash (a sampling operator: ``n`` is what is asked for)."""
    lot = lambda c, k: F.xxhash64(F.col(c), F.lit(seed * 2 + k))
    pick = lambda c, k: edges.select(F.col(c).cast("bigint").alias("node")).distinct().orderBy(lot("node", k), "node").limit(n).withColumn("k", F.row_number().over(Window.orderBy(lot("node", k), "node")))
    return od_paths(edges, pick("f", 0).select("k", F.col("node").alias("o")).join(pick("t", 1).select("k", F.col("node").alias("d")), "k"))


def k_shortest(graph: Graph | dict, o: int, d: int, k: int) -> list[tuple[float, list[int]]]:
    """The k cheapest paths without a node twice, by cost, then nodes."""

    def cheapest(source: int, banned_nodes: set[int], banned: set[tuple[int, int]]) -> tuple[float, list[int]] | None:
        class Left:
            @staticmethod
            def get(node: int, _none: tuple = ()) -> list[tuple[int, float]]:
                return [(t, m) for t, m in graph.get(node, ()) if t not in banned_nodes and (node, t) not in banned]

        return next(((c, p) for e, c, p in _dijkstra(Left, source, math.inf) if e == d), None)

    def cost_of(path: list[int]) -> float:
        return sum(min(m for x, m in graph.get(f) if x == t) for f, t in zip(path, path[1:]))

    first = cheapest(o, set(), set())
    found: list[tuple[float, list[int]]] = [first] if first else []
    waiting: list[tuple[float, list[int]]] = []
    while found and len(found) < k:
        last = found[-1][1]
        for i in range(len(last) - 1):
            root = last[: i + 1]
            banned = {(p[i], p[i + 1]) for _, p in found if p[: i + 1] == root}
            spur = cheapest(root[-1], set(root[:-1]), banned)
            if spur:
                path = root[:-1] + spur[1]
                if all(path != p for _, p in waiting) and all(path != p for _, p in found):
                    heapq.heappush(waiting, (cost_of(path), path))
        if not waiting:
            break
        found.append(heapq.heappop(waiting))
    return found


def k_shortest_paths(edges: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """o, d, rank (from 1), cost, path of the k shortest simple paths of each pair, on a graph of at most GRAPH_ROWS edges."""
    if not fits(edges, GRAPH_ROWS):
        raise ValueError(f"k shortest paths are searched on at most {GRAPH_ROWS} edges; cut out the part of the network first")
    shared = edges.sparkSession.sparkContext.broadcast(Graph.of(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(o, d, r, c, p) for o, d in zip(b["o"], b["d"]) for r, (c, p) in enumerate(k_shortest(shared.value, o, d, k), 1)]
            yield pd.DataFrame(rows, columns=["o", "d", "rank", "cost", "path"])

    p = pairs.select(F.col("o").cast("bigint"), F.col("d").cast("bigint")).where("o != d").distinct()
    return p.repartition("o", "d").mapInPandas(run, "o bigint, d bigint, rank int, cost double, path array<bigint>")


def open_steps(matched: DataFrame, points: DataFrame) -> DataFrame:
    """``gaps`` of a table of matched points."""
    w = by_agent()
    t = points.select("agent_id", "seq", "t_s")
    nxt = F.struct("seq", "from_node", "to_node", "t_s")
    pairs = matched.join(t, ["agent_id", "seq"]).withColumn("n", F.lead(nxt).over(w)).where("n is not null and not (from_node = n.from_node and to_node = n.to_node) and to_node != n.from_node")
    return pairs.select("agent_id", "seq", "t_s", "to_node", F.col("n.from_node").alias("_d"), F.col("n.t_s").alias("t2"))


def completed(matched: DataFrame, points: DataFrame, paths: DataFrame, directed: DataFrame, top_kmh: float = 200.0) -> DataFrame:
    """Rows for the links between two matched ones that don't touch: loc_type 'c', sub_seq from 1.

    They lie on the cached path or, where ``paths`` has none, on the shortest one
    of any length, at their middle; times are spread evenly over them.  Paths that would need more than ``top_kmh`` aren't filled in.
    """
    return filled(staged(open_steps(matched, points)), paths, directed, top_kmh)


def filled(pairs: DataFrame, paths: DataFrame, directed: DataFrame, top_kmh: float = 200.0) -> DataFrame:
    """``completed`` from the steps of ``gaps``, which should be staged."""
    p = paths.select(F.col("o").alias("to_node"), F.col("d").alias("_d"), "cost", "path")
    # a longer path would be too fast; a little more covers rounding
    most = (F.col("t2") - F.col("t_s")) * (top_kmh / 3.6 * (1 + 1e-9)) + 1e-6
    ends = pairs.where("t2 > t_s").select(F.col("to_node").alias("o"), F.col("_d").alias("d"), most.alias("most")).groupBy("o", "d").agg(F.max("most").alias("most")).join(paths.select("o", "d"), ["o", "d"], "left_anti")
    beyond = pair_paths(link_edges(directed), ends)
    p = p.unionByName(beyond.select(F.col("o").alias("to_node"), F.col("d").alias("_d"), "cost", "path"))
    # only paths that are driven
    p = staged(p.join(pairs.select("to_node", "_d").distinct(), ["to_node", "_d"], "left_semi"))
    j = cell_join(pairs, p, ["to_node", "_d"])
    j = j.where((F.col("t2") > F.col("t_s")) & (3.6 * F.col("cost") / (F.col("t2") - F.col("t_s")) < top_kmh))
    legs = F.zip_with(F.slice("path", 1, F.size("path") - 1), F.slice("path", 2, F.size("path") - 1), lambda a, b: F.struct(a.alias("f"), b.alias("t")))
    j = j.select("agent_id", "seq", "t_s", "t2", F.size("path").alias("parts"), F.posexplode(legs).alias("k", "leg"))
    j = j.select("agent_id", "seq", (F.col("k") + 1).alias("sub_seq"), F.col("leg.f").alias("from_node"), F.col("leg.t").alias("to_node"), (F.col("t_s") + (F.col("t2") - F.col("t_s")) * (F.col("k") + 1) / F.col("parts")).alias("t_s"))
    return cell_join(j, staged(_middles(directed)), ["from_node", "to_node"]).withColumn("loc_type", F.lit("c"))


def link_runs(matched: DataFrame, keep: str = "first") -> DataFrame:
    """The first (or last) row of each agent's run on the same (from_node, to_node)."""
    w = by_agent()
    other = (F.lag if keep == "first" else F.lead)(F.struct("from_node", "to_node")).over(w)
    m = matched.withColumn("_o", other)
    return m.where(F.col("_o").isNull() | (F.col("_o") != F.struct("from_node", "to_node"))).drop("_o")
