"""Mixing sources to target shares of the tokens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.timeparse import clean_key
from trackloom.llm.encode import VOCABULARY, token_counts
from trackloom.plans.joins import cell_join
from trackloom.plans.stage import staged

#: Parts that a source's records are dealt into before the last one is cut exactly.
PARTS = 4096


@dataclass(frozen=True)
class Share:
    """What a source gives: size in tokens, wanted tokens, and how often it is gone through."""

    size: int
    wanted: float

    @property
    def epochs(self) -> float:
        return self.wanted / self.size if self.size else 0.0


def covering_total(sizes: dict[str, int], weights: dict[str, float], most: dict[str, int]) -> float:
    """The least total at which no source leaves out a record.

    Water that stands at level v gives v * weight from a source, at most its cap.
    The level that takes the most abundant source through all its records once is
    the greatest size / weight; scarcer ones are repeated, or clamped, below it.
    """
    live = [s for s in weights if sizes.get(s, 0) > 0 and weights[s] > 0 and most.get(s, 0) > 0]
    level = max((sizes[s] / weights[s] for s in live), default=0.0)
    return sum(min(float(sizes[s]) * most[s], level * weights[s]) for s in live)


def water_fill(sizes: dict[str, int], weights: dict[str, float], most: dict[str, int], total: float | None = None) -> dict[str, Share]:
    """Tokens wanted from each source.

    Sources that would be repeated more than ``most`` times are clamped there and
    their excess goes to the others in proportion to their weights, again and
    again until all fit.  Empty sources and those without weight give nothing.
    ``total`` defaults to ``covering_total``.  Beyond what all caps allow the
    total isn't reached.
    """
    live = {s for s in weights if sizes.get(s, 0) > 0 and weights[s] > 0 and most.get(s, 0) > 0}
    cap = {s: float(sizes[s]) * most[s] for s in live}
    if total is None:
        total = covering_total(sizes, weights, most)
    wanted = {s: 0.0 for s in weights}
    free, rest = set(live), float(total)
    while free:
        scale = sum(weights[s] for s in free)
        over = {s for s in free if rest * weights[s] / scale > cap[s] * (1 + 1e-12)}
        if not over:
            wanted |= {s: rest * weights[s] / scale for s in free}
            break
        wanted |= {s: cap[s] for s in over}
        rest -= sum(cap[s] for s in over)
        free -= over
    return {s: Share(sizes.get(s, 0), wanted[s]) for s in weights}


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens, repeats of the chosen records (repeats >= 1).

    ``docs`` has doc_id, text, source; ``targets`` has source, target_share and
    max_repeats, few rows.  Source names are compared in lower case without
    surrounding white space.  Sizes are token counts of whole texts.  A source
    that ``water_fill`` goes through e times has all its records floor(e) times
    and, once more, records in a seeded random order until their tokens reach
    the fraction; never more than max_repeats times.  The order is a hash of
    seed and doc_id: records are dealt into PARTS parts whose sums are
    aggregated, whole parts are taken, and only the part in which the fraction
    ends is put in order, so no source is sorted in one task.  Records without
    tokens or of a source without target aren't chosen; repeated targets of a
    source add up; records repeated in ``docs`` each count; empty inputs give no
    rows.  Without a total no record of a targeted source is left out
    (``covering_total``): the most abundant one is gone through once, scarce ones
    are repeated, and those that can't be repeated so often are clamped and their
    excess goes to the others.
    """
    wanted = {
        r["source"]: r
        for r in targets.select(clean_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("m"))
        .collect()
    }
    named = docs.select("doc_id", clean_key(F.col("source")).alias("source"), "text").where(F.col("source").isin(list(wanted)))
    lot = F.xxhash64(F.lit(seed), "doc_id")
    counted = staged(token_counts(named, vocabulary).where("n_tokens > 0").withColumn("lot", lot).withColumn("part", F.pmod("lot", F.lit(PARTS)).cast("int")))
    parts = counted.groupBy("source", "part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs"))
    sizes = {r["source"]: r["n"] for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    weights = {s: float(r["w"] or 0) for s, r in wanted.items()}
    share = water_fill(sizes, weights, {s: int(r["m"] or 0) for s, r in wanted.items()}, total_tokens)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, int(v.epochs + 1e-9), max(0.0, v.wanted - int(v.epochs + 1e-9) * v.size)) for s, v in share.items()] or [("", 0, 0.0)], "source string, whole int, fraction double")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cut = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(plan), "source")
    dealt = cut.select("source", "part", "whole", (F.col("fraction") - F.col("before")).alias("left"), (F.col("before") + F.col("n") <= F.col("fraction")).alias("all"))
    rows = cell_join(counted, staged(dealt), ["source", "part"])  # at most PARTS rows a source
    inner = Window.partitionBy("source", "part").orderBy("lot", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where("not all and left > 0").withColumn("so_far", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    # a record is taken if at least half of it fits in
    edge = edge.withColumn("extra", (F.col("left") - F.col("so_far") >= F.col("n_tokens") / 2).cast("int")).drop("so_far")
    rest = rows.where("all or left <= 0").withColumn("extra", F.col("all").cast("int"))
    return edge.unionByName(rest).withColumn("repeats", F.col("whole") + F.col("extra")).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, docs, tokens, share of every target; share is null if nothing was chosen at all."""
    t = targets.select(clean_key(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    both = t.join(got, "source", "left").fillna(0, ["docs", "tokens"])
    return both.withColumn("_all", F.sum("tokens").over(Window.partitionBy())).select("source", "target_share", "docs", "tokens", F.try_divide(F.col("tokens"), F.col("_all")).alias("share"))
