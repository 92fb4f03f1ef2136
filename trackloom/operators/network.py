"""Road links: directions, identifiers, lengths, degrees, merging of nodes.

Links have link_id, from_node, to_node, dir (1 forward, -1 backward, 0 both) and
length.  Unless said otherwise null ends or directions drop the link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.plans.joins import cell_join, fits
from trackloom.plans.numbering import number_rows
from trackloom.plans.stage import staged


def checked(links: DataFrame, loops: bool = False) -> DataFrame:
    """Links with both ends and a known direction; self-loops only if asked for."""
    ok = F.col("from_node").isNotNull() & F.col("to_node").isNotNull() & F.col("dir").isin(0, 1, -1)
    return links.where(ok if loops else ok & (F.col("from_node") != F.col("to_node")))


def directed_links(links: DataFrame, geometry: str | None = None) -> DataFrame:
    """One row a direction that can be driven: backward links swap their ends and turn their geometry.

    Of rows with the same ends the first is kept: forward before backward, then
    by link_id.  Adds reverse.
    """
    turn = lambda a, b: F.when(F.col("reverse"), F.col(b)).otherwise(F.col(a))
    ways = F.when(F.col("dir") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.col("dir") == -1))
    d = checked(links).withColumn("reverse", F.explode(ways))
    d = d.withColumn("_f", turn("from_node", "to_node")).withColumn("to_node", turn("to_node", "from_node")).withColumn("from_node", F.col("_f")).drop("_f")
    if geometry:
        d = d.withColumn(geometry, F.when(F.col("reverse"), F.reverse(geometry)).otherwise(F.col(geometry)))
    w = Window.partitionBy("from_node", "to_node").orderBy("reverse", "link_id")
    return d.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def with_single_ids(directed: DataFrame) -> DataFrame:
    """Adds single_link_id, from 0, forward links first, each by link_id."""
    return number_rows(directed, ["reverse", "link_id"], "single_link_id")


def forward_only(links: DataFrame, geometry: str | None = None) -> DataFrame:
    """Links with dir -1 rewritten as dir 1: ends swapped, geometry turned."""
    back = F.col("dir") == -1
    d = links.withColumn("_f", F.when(back, F.col("to_node")).otherwise(F.col("from_node"))).withColumn("to_node", F.when(back, F.col("from_node")).otherwise(F.col("to_node")))
    if geometry:
        d = d.withColumn(geometry, F.when(back, F.reverse(geometry)).otherwise(F.col(geometry)))
    return d.withColumn("from_node", F.col("_f")).withColumn("dir", F.when(back, 1).otherwise(F.col("dir"))).drop("_f")


def fold_two_way(links: DataFrame, attributes: list[str]) -> DataFrame:
    """Directed links whose attributes come from ``<name>_ab`` forward and ``<name>_ba`` backward."""
    ways = F.when(F.col("dir") == 0, F.array(F.lit(1), F.lit(-1))).otherwise(F.array(F.col("dir")))
    d = checked(links).withColumn("_w", F.explode(ways))
    back = F.col("_w") == -1
    pick = [F.when(back, F.col(f"{a}_ba")).otherwise(F.col(f"{a}_ab")).alias(a) for a in attributes]
    return d.select("link_id", F.when(back, F.col("to_node")).otherwise(F.col("from_node")).alias("from_node"), F.when(back, F.col("from_node")).otherwise(F.col("to_node")).alias("to_node"), F.lit(1).alias("dir"), "length", *pick)


def merge_double(links: DataFrame, by_length: bool = True) -> DataFrame:
    """Forward links that run opposite to each other become one with dir 0, that with the least link_id.

    With ``by_length`` they are told by their unordered ends and whole metres of
    length, and all of them that agree become one.  Without it links between the
    same nodes fit whatever their course; repeated ones, with the same ends in
    the same order, are dropped first but for the least link_id.
    """
    one = F.col("dir") == 1
    if not by_length:
        same = Window.partitionBy("from_node", "to_node", one).orderBy("link_id")
        links = links.withColumn("_k", F.row_number().over(same)).where(~one | (F.col("_k") == 1)).drop("_k")
    key = [F.least("from_node", "to_node"), F.greatest("from_node", "to_node"), *([F.floor("length")] if by_length else [])]
    w = Window.partitionBy(*key, one)
    d = links.withColumn("_ways", F.size(F.collect_set("from_node").over(w))).withColumn("_k", F.row_number().over(w.orderBy("link_id")))
    both = one & (F.col("_ways") == 2)
    return d.where(~both | (F.col("_k") == 1)).withColumn("dir", F.when(both, 0).otherwise(F.col("dir"))).drop("_ways", "_k")


def node_degrees(links: DataFrame) -> DataFrame:
    """node_id, degree (different neighbours), out_degree, in_degree (directions that can be driven)."""
    ends = checked(links).select(
        F.explode(
            F.array(
                F.struct(F.col("from_node").alias("n"), F.col("to_node").alias("m"), (F.col("dir") != -1).cast("int").alias("o"), (F.col("dir") != 1).cast("int").alias("i")),
                F.struct(F.col("to_node").alias("n"), F.col("from_node").alias("m"), (F.col("dir") != 1).cast("int").alias("o"), (F.col("dir") != -1).cast("int").alias("i")),
            )
        ).alias("e")
    )
    return ends.groupBy(F.col("e.n").alias("node_id")).agg(F.countDistinct("e.m").alias("degree"), F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def divide_links(links: DataFrame, divide_m: float, least_m: float) -> DataFrame:
    """link_id, piece, from_m, to_m: links cut every ``divide_m``; a rest of at most ``least_m`` stays with the last piece."""
    n = F.floor(F.col("length") / divide_m).cast("int")
    pieces = F.greatest(F.lit(1), F.when(F.col("length") - n * divide_m > least_m, n + 1).otherwise(n))
    d = links.where(F.col("length") > 0).withColumn("_n", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.select("link_id", "piece", (F.col("piece") * F.lit(float(divide_m))).alias("from_m"), F.when(F.col("piece") == F.col("_n") - 1, F.col("length")).otherwise((F.col("piece") + 1) * F.lit(float(divide_m))).alias("to_m"))


def line_length(points: Column) -> Column:
    """Length of an array<struct<x,y>>."""
    step = lambda p, q: F.sqrt((q["x"] - p["x"]) ** 2 + (q["y"] - p["y"]) ** 2)
    return F.aggregate(F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), step), F.lit(0.0), lambda a, d: a + d)


def segments(links: DataFrame, geometry: str = "pts") -> DataFrame:
    """Segments of each link's array<struct<x,y>>: link_id, topo_seq, x1, y1, x2, y2, seg_length, seg_acc (length up to its end), seg_count."""
    ends = F.zip_with(F.slice(geometry, 1, F.size(geometry) - 1), F.slice(geometry, 2, F.size(geometry) - 1), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))
    s = links.where(F.size(geometry) >= 2).select("link_id", F.posexplode(ends).alias("topo_seq", "s")).select("link_id", "topo_seq", "s.*")
    s = s.withColumn("seg_length", F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2))
    w = Window.partitionBy("link_id").orderBy("topo_seq")
    return s.withColumn("seg_acc", F.sum("seg_length").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("seg_count", F.count(F.lit(1)).over(Window.partitionBy("link_id")))


def along_cells(s: DataFrame, size: float, margin: float) -> DataFrame:
    """Adds cx, cy: the square cells of ``size`` that hold all points within ``margin`` of the segment x1, y1, x2, y2.

    In each column of cells only the part of the segment counts that points of
    that column can lie near to, so cells grow with a segment's length and not
    with the area of its box.  A millimetre more covers rounding.
    """
    cell = lambda c: F.floor(c / size).cast("bigint")
    wide = margin + 1e-3
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = s.withColumn("cx", F.explode(F.sequence(cell(F.least("x1", "x2") - wide), cell(F.greatest("x1", "x2") + wide))))
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(x - F.col("x1"), ux)))
    upright = F.col("x1") == F.col("x2")
    a, b = at(F.col("cx") * size - wide), at((F.col("cx") + 1) * size + wide)
    ya = F.when(upright, F.col("y1")).otherwise(F.col("y1") + a * uy)
    yb = F.when(upright, F.col("y2")).otherwise(F.col("y1") + b * uy)
    return s.withColumn("cy", F.explode(F.sequence(cell(F.least(ya, yb) - wide), cell(F.greatest(ya, yb) + wide))))


def weighted_speed(rows: DataFrame, keys: list[str], speed: str = "speed", length: str = "length") -> DataFrame:
    """keys, mean_speed: speeds weighted by length, null speeds left out; null if nothing is left."""
    v, m = F.col(speed).cast("double"), F.when(F.col(speed).isNotNull(), F.col(length).cast("double"))
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(v * m), F.sum(m)).alias("mean_speed"))


def nodes_from_ends(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id from 1 in order of x, y) at the ends of lines, and links between them.

    ``lines`` has link_id and pts; ends with exactly equal coordinates are one
    node.  Lines that start and end at one node and repeated pairs of ends (all
    but that with the least link_id) are left out of the links.
    """
    ends = lines.where(F.size("pts") >= 2).select("link_id", "pts", F.col("pts")[0].alias("a"), F.element_at("pts", -1).alias("b"))
    xy = ends.select(F.explode(F.array("a", "b")).alias("p")).select("p.x", "p.y").distinct()
    nodes = staged(number_rows(xy, ["x", "y"], "node_id", 1))
    at = lambda side, name: nodes.select(F.struct("x", "y").alias(side), F.col("node_id").alias(name))
    links = ends.join(at("a", "from_node"), "a").join(at("b", "to_node"), "b").where("from_node != to_node")
    w = Window.partitionBy("from_node", "to_node").orderBy("link_id")
    links = links.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return nodes, links.select("link_id", "from_node", "to_node", F.lit(0).alias("dir"), F.round(line_length(F.col("pts")), 2).alias("length"), "pts")


def split_at_vertices(lines: DataFrame) -> DataFrame:
    """Every segment of every line once: x1, y1, x2, y2, and path_id and road_name of the line that comes first; segments without length are left out."""
    s = segments(lines.select(F.col("path_id").alias("link_id"), "pts")).where("seg_length > 0")
    once = s.groupBy("x1", "y1", "x2", "y2").agg(F.min("link_id").alias("path_id"))
    return once.join(lines.groupBy("path_id").agg(F.min("road_name").alias("road_name")), "path_id").select("x1", "y1", "x2", "y2", "path_id", "road_name")


#: Edges (both ways) up to which components are found in one task.
ONE_TASK = 1_000_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = list(batches)
    if not rows:
        return
    e = pd.concat(rows)
    names, ends = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]), return_inverse=True)
    a, b = ends[: len(e)], ends[len(e) :]
    root = np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pd.DataFrame({"node": names, "component": names[root]})


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node of it) of an undirected graph.

    Every round a node takes the least label among its own, its neighbours' and
    its label's label; with the jumps to the label's label the rounds grow with
    the logarithm of a chain's length.  Each round is staged; only a count
    comes to the driver.  A graph of at most ONE_TASK edges is joined in one task
    instead, with the same result.  Loops are fine; nodes without edges must be
    added as loops.
    """
    both = staged(edges.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e")).select("e.u", "e.v").where("u is not null and v is not null").distinct())
    if fits(both, ONE_TASK):
        kind = dict(both.dtypes)["u"]
        return both.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}")
    label = staged(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = both.join(label.select(F.col("u").alias("v"), F.col("c")), "v").groupBy("u").agg(F.min("c").alias("n"))
        step = label.join(near, "u").select("u", F.least("c", "n").alias("c0"), F.col("c").alias("old"))
        # the least label found for a label's own node is passed on to all that bear it
        hooks = step.groupBy(F.col("old").alias("u")).agg(F.min("c0").alias("h"))
        step = step.join(hooks, "u", "left").select("u", F.least("c0", F.coalesce("h", "c0")).alias("c1"), "old")
        jump = step.select(F.col("u").alias("c1"), F.col("c1").alias("j"))
        new = staged(step.join(jump, "c1", "left").select("u", F.least("c1", F.coalesce("j", "c1")).alias("c"), "old"))
        if not new.where("c != old").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        label = new.select("u", "c")


def merge_near_nodes(nodes: DataFrame, links: DataFrame, gap_m: float) -> tuple[DataFrame, DataFrame]:
    """(node_id, kept_id) and the relinked links: nodes at most ``gap_m`` apart, by chains, become one.

    ``nodes`` has node_id, x, y in metres.  The node of greatest degree survives,
    of equals the least id.  Links inside a group vanish; of links that come to
    share their ends the least link_id stays.
    """
    comp = near_groups(nodes.select(F.col("node_id").alias("id"), "x", "y"), gap_m)
    deg = node_degrees(links).select(F.col("node_id").alias("node"), "degree")
    w = Window.partitionBy("component").orderBy(F.desc("degree"), "node")
    kept = comp.join(deg, "node", "left").fillna(0, ["degree"]).withColumn("kept_id", F.first("node").over(w)).select(F.col("node").alias("node_id"), "kept_id")
    kept = staged(kept)
    to = lambda name: kept.select(F.col("node_id").alias(name), F.col("kept_id").alias(f"_{name}"))
    out = links.join(to("from_node"), "from_node").join(to("to_node"), "to_node").withColumn("from_node", F.col("_from_node")).withColumn("to_node", F.col("_to_node")).drop("_from_node", "_to_node").where("from_node != to_node")
    first = Window.partitionBy("from_node", "to_node").orderBy("link_id")
    return kept, out.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def near_groups(points: DataFrame, radius: float) -> DataFrame:
    """node, component: points (id, x, y) joined by chains of steps of at most ``radius``.

    Cells measure radius / sqrt(2), so all points of one cell belong together and
    are linked to its least id.  Between different cells one pair that is near
    enough suffices, so what goes on is a link a pair of cells, not a pair of
    points.
    """
    size = radius / 2**0.5
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint")
    p = points.where("x is not null and y is not null").withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    p = staged(p.withColumn("least", F.min("id").over(Window.partitionBy("cx", "cy"))))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1, 2) for j in (-2, -1, 0, 1, 2) if (i, j) > (0, 0)])
    right = p.select(F.col("least").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    left = p.select(F.col("least").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", F.explode(steps).alias("s")).select("a", "ax", "ay", (F.col("cx") + F.col("s.i")).alias("cx"), (F.col("cy") + F.col("s.j")).alias("cy"))
    near = (F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 <= radius * radius
    between = cell_join(left, right, ["cx", "cy"]).where(near).select("a", "b").distinct()
    return components(p.select(F.col("id").alias("a"), F.col("least").alias("b")).unionByName(between))


def near_pairs(points: DataFrame, radius: float) -> DataFrame:
    """a < b, dist of points (id, x, y) at most ``radius`` apart: one side has its cell, the other the cells around."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    p = points.where("x is not null and y is not null")
    left = p.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), cell("x").alias("cx"), cell("y").alias("cy"))
    right = p.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx"), cell("y").alias("_y")).withColumn("cy", F.explode(F.sequence(F.col("_y") - 1, F.col("_y") + 1))).drop("_y")
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return cell_join(left, right, ["cx", "cy"]).where("a < b").select("a", "b", d.alias("dist")).where(F.col("dist") <= radius)


def chain_nodes(links: DataFrame) -> DataFrame:
    """node_id of inner nodes of chains: two neighbours, and as many ways in as out (one or two each)."""
    d = node_degrees(links)
    return d.where("degree = 2 and out_degree = in_degree and out_degree in (1, 2)").select("node_id")


def chains(links: DataFrame, inner: DataFrame | None = None) -> DataFrame:
    """link_id, chain (least link_id of it): links joined at inner chain nodes, or at the given ones of them."""
    inner = chain_nodes(links) if inner is None else inner
    ends = checked(links).select("link_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    at = ends.join(inner, "node_id").groupBy("node_id").agg(F.min("link_id").alias("a"), F.max("link_id").alias("b"))
    linked = at.select("a", "b").unionByName(checked(links).select(F.col("link_id").alias("a"), F.col("link_id").alias("b")))
    return components(linked).select(F.col("node").alias("link_id"), F.col("component").alias("chain"))
