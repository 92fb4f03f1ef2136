"""Sessions by a sweep line over opening and closing deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.pings import DAY_S, SESSION_GAP_S, day_events
from trackloom.plans.stage import staged


def sweep_sessions(ev: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """agent_id, start_s, end_s, duration_s, n_events of every session.

    ``ev`` is ``day_events`` with the last ``gap_s`` seconds before each day.
    Every event adds one at its second and takes one away ``gap_s`` later; at
    equal seconds the additions come first, so a gap of exactly ``gap_s`` keeps
    a session open.  Where the running sum leaves zero a session starts, where
    it returns to zero it ends.  An event closes after ``gap_s``, so what is
    still open when a day begins was opened in its halo: the sum runs inside an
    agent's day, without a look at other days and without another shuffle.  A
    day's pieces between two ends are aggregated there, and a window over these
    few rows joins the pieces of sessions that last beyond a day.  Events at the
    same second count once; an empty input gives no rows; null agents or times
    must have been left out before (``usable_pings``).
    """
    one = lambda t, d, own: F.struct(F.col("day"), t.alias("t"), F.lit(d).alias("d"), own.alias("own"))
    own = (F.floor(F.col("s") / DAY_S) == F.col("day")).cast("int")
    deltas = ev.select("agent_id", "day", F.explode(F.array(one(F.col("s"), 1, own), one(F.col("s") + gap_s, -1, F.lit(0)))).alias("x")).select("agent_id", "day", "x.t", "x.d", "x.own").where(F.col("t") < (F.col("day") + 1) * DAY_S)
    order = Window.partitionBy("agent_id", "day").orderBy("t", F.desc("d"))
    crossed = (
        deltas.withColumn("open", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("t") >= F.col("day") * DAY_S)
        .withColumn("starts", (F.col("d") == 1) & (F.col("open") == 1))
        .withColumn("ends", (F.col("d") == -1) & (F.col("open") == 0))
        .withColumn("piece", F.sum(F.col("ends").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("ends").cast("int"))
    )
    pieces = crossed.groupBy("agent_id", "day", "piece").agg(F.min(F.when(F.col("starts"), F.col("t"))).alias("start_s"), F.max(F.when(F.col("ends"), F.col("t") - gap_s)).alias("end_s"), F.sum("own").alias("n"))
    # at most DAY_S / gap_s + 1 pieces a day
    by_agent = Window.partitionBy("agent_id").orderBy("day", "piece").rowsBetween(Window.unboundedPreceding, 0)
    return (
        pieces.withColumn("_session", F.last("start_s", ignorenulls=True).over(by_agent))
        .groupBy("agent_id", F.col("_session").alias("start_s"))
        .agg(F.max("end_s").alias("end_s"), F.sum("n").alias("n_events"))
        .select("agent_id", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "n_events")
    )


def session_events(raw: DataFrame, gap_s: int = SESSION_GAP_S) -> DataFrame:
    """One row an event with its session: agent_id, day, start_s, s, lng, lat.

    Sessions are few; they are joined to the events by the days they touch, of
    which each has at most DAY_S / gap_s + 1 sessions.
    """
    at = lambda c: F.floor(F.col(c) / DAY_S).cast("bigint")
    ev = staged(day_events(raw, before_s=gap_s))
    found = sweep_sessions(ev, gap_s).select("agent_id", "start_s", "end_s", F.explode(F.sequence(at("start_s"), at("end_s"))).alias("day"))
    own = ev.where(F.col("day") == at("s"))
    return own.join(found, ["agent_id", "day"]).where("s between start_s and end_s").select("agent_id", "day", "start_s", "s", "lng", "lat")
