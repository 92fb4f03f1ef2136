"""Irregular readings of counters onto a regular grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geo import great_circle_m
from trackloom.operators.pings import DAY_S, SESSION_GAP_S, day_events


def increments(readings: DataFrame, keys: list[str], at: str, value: str, step: int, monotone: bool = True) -> DataFrame:
    """keys, cell_s, increment: what a cumulative counter gained in each cell.

    Consecutive readings are differenced; with ``monotone`` a fall is a reset
    and the new reading itself is the gain.  A gain is spread over the cells
    [cell_s, cell_s + step) in proportion to their overlap with the interval of
    its two readings.  Null values are passed over; ties in time keep the
    greatest value; a single reading gives no cells; an empty table gives none.
    """
    r = readings.where(F.col(value).isNotNull() & F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("_t")).agg(F.max(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_t")
    r = r.withColumn("_t2", F.lead("_t").over(w)).withColumn("_v2", F.lead("_v").over(w)).where("_t2 is not null")
    gain = F.when(F.lit(monotone) & (F.col("_v2") < F.col("_v")), F.col("_v2")).otherwise(F.col("_v2") - F.col("_v"))
    return (
        r.select(*keys, "_t", "_t2", gain.alias("_gain"), F.explode(F.sequence(cell(F.col("_t"), step), cell(F.col("_t2") - 1, step), F.lit(step).cast("bigint"))).alias("cell_s"))
        .groupBy(*keys, "cell_s")
        .agg(F.sum(F.col("_gain") * overlap(F.col("cell_s"), step, F.col("_t"), F.col("_t2")) / (F.col("_t2") - F.col("_t"))).alias("increment"))
    )


def cell(t: Column, step: int) -> Column:
    return (F.floor(t / step) * step).cast("bigint")


def overlap(c: Column, step: int, t1: Column, t2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(c + step, t2) - F.greatest(c, t1)).cast("double")


def counter_readings(ev: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """Every event of ``day_events`` as a reading of three counters: adds n, odo_m, and the last position ps, plng, plat.

    n counts a session's events, odo_m the metres from position to position;
    both begin anew with a session, n at 1 and odo_m at 0.  ps, plng and plat are
    time and place of the last located event of the session before this one.
    """
    day = Window.partitionBy("agent_id", "day").orderBy("s")
    within = Window.partitionBy("agent_id", "day", "_session").orderBy("s")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("s") - F.lag("s").over(day) > gap_s, F.lit(True)).cast("int")
    e = ev.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("lng").isNotNull(), F.struct("s", "lng", "lat")), ignorenulls=True).over(before)
    e = e.withColumn("_p", last).withColumn("n", F.row_number().over(within))
    way = F.coalesce(great_circle_m(F.col("_p.lng"), F.col("_p.lat"), F.col("lng"), F.col("lat")), F.lit(0.0))
    e = e.withColumn("_way", way).withColumn("odo_m", F.sum("_way").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("agent_id", "day", "s", "lng", "lat", "n", "odo_m", F.col("_p.s").alias("ps"), F.col("_p.lng").alias("plng"), F.col("_p.lat").alias("plat"))


def session_grid(raw: DataFrame, step: int = 300, bridge_s: int = 3_600) -> DataFrame:
    """One row per agent and ``step`` seconds of each session: agent_id, period_s, lng, lat, moved_m, n_located, covered.

    Three counters are read at every event (``counter_readings``): the number of
    the session's events, its metres, and, as counters that may fall, the two
    coordinates.  Consecutive readings of an agent are differenced.  Where the
    number of events fails to rise or the metres fall, the counters were reset: a
    session ended, and nothing is spread between the two.  Any other difference
    is spread over the periods between its readings in proportion to their
    overlap; these periods, and those of the readings themselves, are the
    session's.  A period that gains no located reading is uncovered.  A covered
    period has the mean of its positions; an uncovered one between two positions
    at most ``bridge_s`` apart has the coordinates' counters at its middle, a
    longer wait or an end of the session leaves them null: the period is only
    marked.  Everything happens within (agent, day) and a halo of ``bridge_s``.

    ``step`` divides a day and ``bridge_s`` is at least the session's gap.  Null
    agents and times have been left out; ties of deliveries are one event; an
    empty table gives no rows; further columns are ignored.
    """
    if DAY_S % step or bridge_s < SESSION_GAP_S:
        raise ValueError("a day must be a multiple of step, bridge_s at least the gap of a session")
    r = counter_readings(day_events(raw, bridge_s, bridge_s))
    w = Window.partitionBy("agent_id", "day").orderBy("s")
    r = r.withColumn("_was", F.lag(F.struct("s", "n", "odo_m")).over(w))
    # a counter of events rises by one from reading to reading of a session
    reset = F.coalesce((F.col("n") <= F.col("_was.n")) | (F.col("odo_m") < F.col("_was.odo_m")), F.lit(True))
    r = r.withColumn("_t1", F.when(~reset, F.col("_was.s"))).withColumn("_gain", F.when(~reset, F.col("odo_m") - F.col("_was.odo_m")))
    t1, t2, shown = F.col("_t1"), F.col("s"), F.col("lng").isNotNull()
    # metres were made since the last position, which is as long ago as it is, but not beyond the bridge
    since = F.when(shown & (F.col("ps") >= t2 - bridge_s), F.col("ps"))
    first = cell(F.coalesce(F.least(since, t1), t1, t2), step)
    cells = r.withColumn("_since", since).withColumn("period_s", F.explode(F.sequence(first, cell(t2, step), F.lit(step).cast("bigint"))))
    p = F.col("period_s")
    cells = cells.where((p >= F.col("day") * DAY_S) & (p < (F.col("day") + 1) * DAY_S))
    own = p == cell(t2, step)
    # ticks land where they are read, metres and coordinates are spread since the last position
    part = overlap(p, step, F.col("_since"), t2) / (t2 - F.col("_since"))
    middle = (p + step / 2.0 - F.col("_since")) / (t2 - F.col("_since"))
    inner = (middle >= 0) & (middle <= 1)
    # the shorter way around the globe
    turn = F.col("lng") - F.col("plng")
    turn = F.when((F.abs("lng") <= 180) & (F.abs("plng") <= 180), turn - 360 * F.round(turn / 360)).otherwise(turn)
    across = F.col("plng") + turn * middle
    across = F.when((F.abs("lng") <= 180) & (F.abs("plng") <= 180), across - 360 * F.round(across / 360)).otherwise(across)
    inside = (p >= cell(F.coalesce(t1, t2), step)) | F.col("_since").isNotNull()
    return (
        cells.where(inside)
        .groupBy("agent_id", "day", "period_s")
        .agg(
            F.sum(F.col("_gain") * part).alias("moved_m"),
            F.sum((own & shown).cast("int")).alias("n_located"),
            F.avg(F.when(own & shown, F.col("lng"))).alias("_lng"),
            F.avg(F.when(own & shown, F.col("lat"))).alias("_lat"),
            F.max(F.when(inner, across)).alias("_mlng"),
            F.max(F.when(inner, F.col("plat") + (F.col("lat") - F.col("plat")) * middle)).alias("_mlat"),
        )
        .select("agent_id", "period_s", F.coalesce("_lng", "_mlng").alias("lng"), F.coalesce("_lat", "_mlat").alias("lat"), "moved_m", "n_located", (F.col("n_located") > 0).alias("covered"))
    )
