"""Building and repairing road networks: splitting, joining, pruning, renumbering.

Links have link_id, from_node, to_node, dir (1 forward, 0 both), length, pts and
any further columns, which are copied; nodes have node_id, x, y.  Lengths and
coordinates are metres on a plane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators import lines, network
from trackloom.plans.numbering import number_rows
from trackloom.plans.stage import staged


def greatest_id(df: DataFrame, name: str) -> int:
    return df.agg(F.coalesce(F.max(name), F.lit(0)).alias("m")).first()["m"]


def split_links(links: DataFrame, nodes: DataFrame, cuts: DataFrame, tolerance_m: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) after cutting links at measures.

    ``cuts`` has link_id, at_m and optionally node_id, an existing node to be
    used there.  Cuts within ``tolerance_m`` of an end, of links that don't exist,
    and all but the first of cuts nearer than that to each other are left out.
    A link's first piece keeps its id, others take free ones in order of link
    and measure; new nodes are numbered the same way.  Adds parent_link.
    """
    if "node_id" not in cuts.columns:
        cuts = cuts.withColumn("node_id", F.lit(None).cast("bigint"))
    length = links.select("link_id", network.line_length(F.col("pts")).alias("_all"))
    c = cuts.join(length, "link_id").where((F.col("at_m") > tolerance_m) & (F.col("at_m") < F.col("_all") - tolerance_m))
    by_link = Window.partitionBy("link_id").orderBy("at_m", F.col("node_id").asc_nulls_last())
    c = c.withColumn("_gap", F.col("at_m") - F.lag("at_m").over(by_link)).where(F.col("_gap").isNull() | (F.col("_gap") > tolerance_m)).drop("_gap")
    c = staged(c.withColumn("k", F.row_number().over(by_link)))
    free = greatest_id(nodes, "node_id") + 1
    fresh = number_rows(c.where("node_id is null").select("link_id", "k"), ["link_id", "k"], "_new", free)
    c = c.join(fresh, ["link_id", "k"], "left").select("link_id", "k", "at_m", "_all", F.coalesce("node_id", "_new").alias("node_id"))
    # piece k lies between cut k and cut k + 1
    ends = F.lead(F.struct("at_m", "node_id")).over(Window.partitionBy("link_id").orderBy("k"))
    head = c.where("k = 1").select("link_id", F.lit(0).alias("piece"), F.lit(0.0).alias("from_m"), F.col("at_m").alias("to_m"), F.lit(None).cast("bigint").alias("_f"), F.col("node_id").alias("_t"))
    rest = c.withColumn("_n", ends).select("link_id", F.col("k").alias("piece"), F.col("at_m").alias("from_m"), F.coalesce("_n.at_m", "_all").alias("to_m"), F.col("node_id").alias("_f"), F.col("_n.node_id").alias("_t"))
    pieces = staged(head.unionByName(rest))
    parts = staged(lines.line_pieces(links.select("link_id", "pts"), pieces).join(pieces.select("link_id", "piece", "from_m", "to_m", "_f", "_t"), ["link_id", "piece"]))
    ids = number_rows(parts.where("piece > 0").select("link_id", "piece"), ["link_id", "piece"], "_id", greatest_id(links, "link_id") + 1)
    cut = parts.withColumnRenamed("pts", "_pts").join(ids, ["link_id", "piece"], "left").join(links, "link_id")
    own = {"link_id": F.coalesce("_id", "link_id"), "from_node": F.coalesce("_f", "from_node"), "to_node": F.coalesce("_t", "to_node"), "length": F.col("to_m") - F.col("from_m"), "pts": F.col("_pts")}
    cut = cut.select(*[own.get(n, F.col(n)).alias(n) for n in links.columns], F.col("link_id").alias("parent_link"))
    whole = links.join(c.select("link_id").distinct(), "link_id", "left_anti").select(*links.columns, F.col("link_id").alias("parent_link"))
    made = parts.where("piece > 0 and _f >= " + str(free)).select(F.col("_f").alias("node_id"), F.col("pts")[0]["x"].alias("x"), F.col("pts")[0]["y"].alias("y"))
    return whole.unionByName(cut), nodes.select("node_id", "x", "y").unionByName(made)


def divide(links: DataFrame, nodes: DataFrame, divide_m: float, least_m: float) -> tuple[DataFrame, DataFrame]:
    """Links cut every ``divide_m``; a rest of at most ``least_m`` stays with the last piece."""
    measured = links.select("link_id", network.line_length(F.col("pts")).alias("length"))
    cuts = network.divide_links(measured, divide_m, least_m).where("piece > 0").select("link_id", F.col("from_m").alias("at_m"))
    return split_links(links, nodes, cuts, 0.0)


def split_at_points(links: DataFrame, nodes: DataFrame, points: DataFrame, radius_m: float, tolerance_m: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Every point (point_id, x, y) becomes a break of its nearest link within ``radius_m``; points near a link's end don't."""
    near = lines.nearest_on_lines(points, links, radius_m)
    first = near.groupBy("point_id").agg(F.min(F.struct("dist_m", "link_id", "along_m")).alias("b"))
    return split_links(links, nodes, first.select("b.link_id", F.col("b.along_m").alias("at_m")).distinct(), tolerance_m)


def split_loops(links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Self-loops are cut in thirds, and all but the first of links with the same ends in halves, so that no two share both ends."""
    w = Window.partitionBy("from_node", "to_node").orderBy("link_id")
    d = links.select("link_id", (F.col("from_node") == F.col("to_node")).alias("loop"), F.row_number().over(w).alias("k"), network.line_length(F.col("pts")).alias("m"))
    at = F.when(F.col("loop"), F.array(F.col("m") / 3, F.col("m") * 2 / 3)).when(F.col("k") > 1, F.array(F.col("m") / 2))
    cuts = d.withColumn("at", at).where("at is not null").select("link_id", F.explode("at").alias("at_m"))
    return split_links(links, nodes, cuts, 0.0)


def repair_connections(links: DataFrame, nodes: DataFrame, buffer_m: float, snap_m: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """A node within ``buffer_m`` of a link it isn't an end of breaks that link there.

    Where its foot lies within ``snap_m`` of the link's end, the node is joined to
    the end's node instead (the lesser id stays).  Links that become loops vanish.
    """
    at = nodes.select(F.col("node_id").alias("point_id"), "x", "y")
    near = lines.nearest_on_lines(at, links.select("link_id", "pts"), buffer_m)
    near = near.join(links.select("link_id", "from_node", "to_node", network.line_length(F.col("pts")).alias("_all")), "link_id").where("point_id != from_node and point_id != to_node")
    near = staged(near)
    end = F.when(F.col("along_m") <= snap_m, F.col("from_node")).when(F.col("along_m") >= F.col("_all") - snap_m, F.col("to_node"))
    same = near.withColumn("_end", end).where("_end is not null").select(F.col("point_id").alias("a"), F.col("_end").alias("b"))
    cuts = near.withColumn("_end", end).where("_end is null").select("link_id", F.col("along_m").alias("at_m"), F.col("point_id").alias("node_id"))
    links, nodes = split_links(links, nodes, cuts, snap_m)
    same = staged(same)
    if same.limit(1).count():
        to = staged(network.components(same).where("node != component"))
        links = rename_nodes(links, to).where("from_node != to_node")
        nodes = nodes.join(to.select(F.col("node").alias("node_id")), "node_id", "left_anti")
    return links, nodes


def rename_nodes(links: DataFrame, to: DataFrame) -> DataFrame:
    """Links whose ends named in ``to`` (node, component) take the other name."""
    one = lambda side: to.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))
    out = links.join(one("from_node"), "from_node", "left").join(one("to_node"), "to_node", "left")
    return out.withColumn("from_node", F.coalesce("_from_node", "from_node")).withColumn("to_node", F.coalesce("_to_node", "to_node")).select(*links.columns)


@dataclass(frozen=True)
class Limits:
    """When links of a chain aren't joined."""

    attributes: tuple[str, ...] = ("road_name",)
    angle_deg: float = 35.0
    length_m: float = 500.0
    least_m: float = 25.0


def _turn(a: list, b: list) -> float:
    """Degrees between the last part of one line and the first of the next."""
    ux, uy, vx, vy = a[-1][0] - a[-2][0], a[-1][1] - a[-2][1], b[1][0] - b[0][0], b[1][1] - b[0][1]
    n = math.hypot(ux, uy) * math.hypot(vx, vy)
    return math.degrees(math.acos(max(-1.0, min(1.0, (ux * vx + uy * vy) / n)))) if n else 0.0


def ordered_chain(ids: list[int], f: list[int], t: list[int]) -> list[tuple[int, bool]]:
    """(place, backward) of a chain's links from one end to the other; a ring begins with its least link."""
    at: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(zip(f, t)):
        at.setdefault(a, []).append(i)
        at.setdefault(b, []).append(i)
    lone = sorted((ids[v[0]], n) for n, v in at.items() if len(v) == 1)
    i, node = (at[lone[0][1]][0], lone[0][1]) if lone else (min(range(len(ids)), key=ids.__getitem__), None)
    node = f[i] if node is None else node
    out, used = [], set()
    while i is not None:
        used.add(i)
        out.append((i, f[i] != node))
        node = t[i] if f[i] == node else f[i]
        i = next((k for k in sorted(at[node], key=ids.__getitem__) if k not in used), None)
    return out


def chain_groups(chain: list[tuple[int, bool]], dir_: list[int], attributes: list[tuple], pts: list[list], length: list[float], limits: Limits) -> list[list[tuple[int, bool]]]:
    """Runs of a chain that may be joined.

    A run keeps one kind of direction (both ways, or one way the same way round),
    equal attributes, turns below the limit, and at most the length; a last part
    shorter than ``least_m`` stays with the run before it.
    """
    groups: list[list[tuple[int, bool]]] = []
    laid: list[list] = []
    m = 0.0
    for i, back in chain:
        p = pts[i][::-1] if back else pts[i]
        if groups:
            k, was = groups[-1][-1]
            fits = (dir_[i] == 0) == (dir_[k] == 0) and (dir_[i] == 0 or back == was) and attributes[i] == attributes[k]
            fits = fits and _turn(laid[-1], p) < limits.angle_deg
            if fits and (m + length[i] <= limits.length_m or length[i] < limits.least_m):
                groups[-1].append((i, back))
                laid.append(p)
                m += length[i]
                continue
        groups.append([(i, back)])
        laid.append(p)
        m = length[i]
    return groups


def merge_chains(links: DataFrame, inner: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """Links joined over nodes at which nothing but a road goes on.

    Chains are the components of links at inner nodes (``network.chain_nodes``);
    each is put in order, cut by ``limits``, and every run becomes one link with
    the id and further columns of its least link, the points of all and their
    length.  A run whose ends would be those of another run or of an existing
    link is left as it was.  Chains are as long as a road has no junction; one
    reaches one task, many share one.
    """
    links = network.forward_only(links, "pts")
    chains = network.chains(links, inner).join(links, "link_id")
    used = [a for a in limits.attributes if a in links.columns]

    def join(g: pd.DataFrame) -> list[tuple]:
        ids, f, t = g["link_id"].tolist(), g["from_node"].tolist(), g["to_node"].tolist()
        pts = [[(p["x"], p["y"]) for p in v] for v in g["pts"]]
        attributes = [tuple(None if pd.isna(x) else x for x in r) for r in g[used].itertuples(index=False)] if used else [()] * len(ids)
        rows = []
        for run in chain_groups(ordered_chain(ids, f, t), g["dir"].tolist(), attributes, pts, g["length"].fillna(0.0).tolist(), limits):
            if len(run) < 2:
                continue
            if run[0][1] and g["dir"].iloc[run[0][0]] != 0:
                run = [(i, not back) for i, back in run[::-1]]
            first, last = run[0], run[-1]
            laid = [pts[i][::-1] if back else pts[i] for i, back in run]
            line = laid[0] + [p for part in laid[1:] for p in part[1:]]
            rows.append((min(ids[i] for i, _ in run), [ids[i] for i, _ in run], (t if first[1] else f)[first[0]], (f if last[1] else t)[last[0]], float(np.nansum([g["length"].iloc[i] for i, _ in run])), [{"x": x, "y": y} for x, y in line]))
        return rows

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["link_id", "members", "_f", "_t", "_length", "_pts"]
        rest: list[pd.DataFrame] = []
        for b in batches:
            rows: list[tuple] = []
            for c, g in b.groupby("chain", sort=False):
                if rest and rest[0]["chain"].iloc[0] != c:
                    rows += join(pd.concat(rest))
                    rest = []
                rest.append(g)
            yield pd.DataFrame(rows, columns=names)
        if rest:
            yield pd.DataFrame(join(pd.concat(rest)), columns=names)

    cols = ["chain", "link_id", "from_node", "to_node", "dir", "length", "pts", *used]
    kind = "bigint"
    # most links are a chain of their own and stay out of the kernel
    longer = chains.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("chain"))).where("_n > 1")
    runs = longer.select(*cols).repartition("chain").sortWithinPartitions("chain", "link_id").mapInPandas(stream, f"link_id {kind}, members array<bigint>, _f bigint, _t bigint, _length double, _pts {lines.POINTS}")
    runs = staged(runs.where("_f != _t"))
    ends = lambda d, a, b: d.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    inside = runs.select(F.explode("members").alias("link_id"))
    kept = links.join(inside, "link_id", "left_anti")
    w = Window.partitionBy(F.least("_f", "_t"), F.greatest("_f", "_t")).orderBy("link_id")
    good = runs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").withColumn("a", F.least("_f", "_t")).withColumn("b", F.greatest("_f", "_t"))
    good = staged(good.join(ends(kept, "from_node", "to_node").distinct(), ["a", "b"], "left_anti").drop("a", "b"))
    gone = good.select(F.explode("members").alias("link_id"))
    own = {"from_node": F.col("_f"), "to_node": F.col("_t"), "length": F.col("_length"), "pts": F.col("_pts")}
    merged = good.drop("members").join(links, "link_id").select(*[own.get(n, F.col(n)).alias(n) for n in links.columns])
    return links.join(gone, "link_id", "left_anti").unionByName(merged)


def merge_short(links: DataFrame, threshold_m: float = 25.0, angle_deg: float = 60.0, attributes: tuple[str, ...] = ("road_name",)) -> DataFrame:
    """Links of at most ``threshold_m`` are joined to their neighbour at a node with only two, if they bear the same attributes and don't turn."""
    short = links.where(F.col("length") <= threshold_m).select(F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct()
    inner = network.chain_nodes(links).join(short, "node_id", "left_semi")
    return merge_chains(links, inner, Limits(attributes, angle_deg, math.inf, 0.0))


def drop_overlaps(links: DataFrame, buffer_m: float = 8.0, share: float = 0.6, opposed_deg: float = 120.0) -> DataFrame:
    """Links that run over each other for most of their length become one.

    Two links overlap if ``share`` of either lies within ``buffer_m`` of the
    other.  Of each group so linked the longest stays (of equals the least id);
    it is open both ways if one of the others runs against it.
    """
    cover = lines.coverage(links, links.select(F.col("link_id").alias("other"), "pts"), buffer_m).where((F.col("link_id") != F.col("other")) & (F.col("share") >= share))
    pairs = staged(cover.select("link_id", "other", "cosine"))
    if not pairs.limit(1).count():
        return links
    group = network.components(pairs.select(F.col("link_id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("link_id"), "component")
    w = Window.partitionBy("component").orderBy(F.desc("length"), "link_id")
    best = staged(group.join(links.select("link_id", "length"), "link_id").withColumn("_keep", F.first("link_id").over(w)).select("link_id", F.col("_keep").alias("keep")))
    against = pairs.where(F.col("cosine") <= math.cos(math.radians(opposed_deg))).join(best, "link_id").where((F.col("link_id") == F.col("keep")) | (F.col("other") == F.col("keep"))).select(F.col("keep").alias("link_id")).distinct().withColumn("_both", F.lit(0))
    kept = links.join(best.where("link_id != keep").select("link_id"), "link_id", "left_anti").join(against, "link_id", "left")
    return kept.withColumn("dir", F.coalesce("_both", "dir")).select(*links.columns)


@dataclass(frozen=True)
class Build:
    """Parameters of the whole construction."""

    gap_m: float = 5.0
    buffer_m: float = 3.0
    limits: Limits = Limits()
    overlaps: bool = True
    conn: bool = True


def network_from_paths(paths: DataFrame, p: Build = Build()) -> tuple[DataFrame, DataFrame]:
    """(links, nodes) from lines that were driven: path_id, road_name, pts.

    Every segment once, nodes at its ends, near nodes merged and their links'
    ends moved there, opposite links folded, connections repaired, chains merged,
    overlaps dropped, connections repaired again.
    """
    s = network.split_at_vertices(paths)
    s = number_rows(s, ["x1", "y1", "x2", "y2"], "link_id", 1)
    lone = staged(s.select("link_id", "road_name", F.array(lines.xy(F.col("x1"), F.col("y1")), lines.xy(F.col("x2"), F.col("y2"))).alias("pts")))
    nodes, links = network.nodes_from_ends(lone)
    links = links.withColumn("dir", F.lit(1)).join(lone.select("link_id", "road_name"), "link_id")
    kept, links = network.merge_near_nodes(nodes, links, p.gap_m)
    nodes = staged(nodes.join(kept.where("node_id = kept_id").select("node_id"), "node_id", "left_semi"))
    links = staged(network.merge_double(snap_ends(links, nodes), by_length=False))
    if p.conn:
        links, nodes = (staged(d) for d in repair_connections(links, nodes, p.buffer_m))
    links = staged(merge_chains(links.drop("parent_link"), limits=p.limits))
    if p.overlaps:
        links = staged(drop_overlaps(links, p.buffer_m))
    nodes = staged(used_nodes(links, nodes))
    if p.conn:
        links, nodes = repair_connections(links, nodes, p.buffer_m)
        links = links.drop("parent_link")
    return links, used_nodes(links, nodes)


def snap_ends(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose first and last point are moved to their nodes; lengths follow."""
    at = lambda side: nodes.select(F.col("node_id").alias(side), lines.xy(F.col("x"), F.col("y")).alias(f"_{side}"))
    j = links.join(at("from_node"), "from_node").join(at("to_node"), "to_node")
    pts = F.concat(F.array("_from_node"), F.slice("pts", 2, F.greatest(F.size("pts") - 2, F.lit(0))), F.array("_to_node"))
    return j.withColumn("pts", pts).withColumn("length", F.round(network.line_length(F.col("pts")), 2)).select(*links.columns)


def used_nodes(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that are an end of a link."""
    ends = links.select(F.explode(F.array("from_node", "to_node")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_semi")


def renumber(links: DataFrame, nodes: DataFrame, first_link: int = 1, first_node: int = 1) -> tuple[DataFrame, DataFrame]:
    """Both layers with consecutive ids in order of the old ones."""
    n = staged(number_rows(nodes.select("node_id").distinct(), ["node_id"], "_new", first_node))
    l = number_rows(links.select("link_id").distinct(), ["link_id"], "_id", first_link)
    to = n.select(F.col("node_id").alias("node"), F.col("_new").alias("component"))
    out = rename_nodes(links, to).join(l, "link_id").withColumn("link_id", F.col("_id")).select(*links.columns)
    return out, nodes.join(n, "node_id").withColumn("node_id", F.col("_new")).select(*nodes.columns)


def merged_networks(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both networks with the second one's ids behind the first one's; columns that only one has are null in the other."""
    links, nodes = renumber(*b, greatest_id(a[0], "link_id") + 1, greatest_id(a[1], "node_id") + 1)
    return a[0].unionByName(links, allowMissingColumns=True), a[1].unionByName(nodes, allowMissingColumns=True)


def incremented(links: DataFrame, nodes: DataFrame, paths: DataFrame, buffer_m: float = 8.0, p: Build = Build()) -> tuple[DataFrame, DataFrame]:
    """A network with what new paths add to it.

    A part of the new paths' own network is known if 60 % of it, or 30 % running
    parallel (within 6.5 degrees), lies within ``buffer_m`` of one link; a one-way
    link covered against its direction is opened.  The rest is added with free
    ids, its ends joined to nodes nearby.
    """
    new_links, new_nodes = (staged(d) for d in network_from_paths(paths, p))
    cover = lines.coverage(new_links, links.select(F.col("link_id").alias("other"), "pts"), buffer_m)
    parallel = F.abs("cosine") >= math.cos(math.radians(6.5))
    known = staged(cover.where((F.col("share") >= 0.6) | (F.col("share") >= 0.3) & parallel))
    opened = known.where(F.col("cosine") <= -math.cos(math.radians(6.5))).select(F.col("other").alias("link_id")).distinct().withColumn("_open", F.lit(0))
    links = links.join(opened, "link_id", "left").withColumn("dir", F.coalesce("_open", "dir")).select(*links.columns)
    rest = new_links.join(known.select("link_id"), "link_id", "left_anti")
    links, nodes = (staged(d) for d in merged_networks((links, nodes.select("node_id", "x", "y")), (rest, used_nodes(rest, new_nodes))))
    kept, links = network.merge_near_nodes(nodes, links, p.gap_m)
    nodes = nodes.join(kept.where("node_id = kept_id").select("node_id"), "node_id", "left_semi")
    links, nodes = repair_connections(links, nodes, p.buffer_m)
    return links.drop("parent_link"), nodes


def packed_regions(rows: DataFrame, region: str, most: int) -> DataFrame:
    """Adds bin: regions in order of their id, put together until a bin holds about ``most`` rows (by running counts)."""
    n = rows.groupBy(region).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(region).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    bins = n.withColumn("bin", F.floor(before / most).cast("bigint")).select(region, "bin")  # one row a region
    return rows.join(bins, region)


def checked_layers(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """link_id, node_id of ends that are missing in the node layer; empty if the layers fit."""
    ends = links.select("link_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return ends.join(nodes.select("node_id"), "node_id", "left_anti").select("link_id", "node_id")


def without_short(links: DataFrame, least_m: float) -> DataFrame:
    """Links longer than ``least_m``; those of unknown length stay."""
    return links.where(F.col("length").isNull() | (F.col("length") > least_m))


def links_at(links: DataFrame, nodes: DataFrame, side: str = "from_node") -> DataFrame:
    """Links whose ``side`` is one of the nodes."""
    return links.join(nodes.select(F.col("node_id").alias(side)).distinct(), side, "left_semi").select(*links.columns)


def modified(layer: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``changes`` take its values; other columns and rows stay."""
    names = [c for c in changes.columns if c != key]
    j = layer.join(changes.select(key, F.struct(*names).alias("_c")), key, "left")
    pick: dict[str, Column] = {n: F.when(F.col("_c").isNotNull(), F.col(f"_c.{n}")).otherwise(F.col(n)).alias(n) for n in names}
    return j.select(*[pick.get(n, F.col(n)) for n in layer.columns])


def appended(layer: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The layer and rows with free ids, in order of the ids they bring."""
    fresh = number_rows(rows.select(key).distinct(), [key], "_new", greatest_id(layer, key) + 1)
    return layer.unionByName(rows.join(fresh, key).withColumn(key, F.col("_new")).drop("_new"), allowMissingColumns=True)


def removed(layer: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return layer.join(keys.select(key), key, "left_anti")
