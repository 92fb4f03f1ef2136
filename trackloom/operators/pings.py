"""From raw location rows to events of an agent's days.

An agent has at most one event a second, so a group keyed by agent and UTC day
never holds more than 86,400 events (and those of its halo), however much of the
input one agent sends and however long it keeps sending without a pause.
Everything that looks beyond a day's border either finds what it needs in the
halo or is stitched from one summary row a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.timeparse import clean_key, epoch_seconds

DAY_S = 86_400
SESSION_GAP_S = 1_800


def usable_pings(raw: DataFrame) -> DataFrame:
    """Rows with an agent and a readable time: ping_id, agent_id, s, lng, lat.

    Null or blank agents and missing or unreadable times drop the row.  A
    position counts only if both coordinates are present; with one of them null
    or NaN both come out null.  Columns beyond the five read are ignored, so
    clashing names can't occur.
    """
    number = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    located = number("lng").isNotNull() & number("lat").isNotNull()
    # a generated column keeps the filter above it, so the texts are read only once
    key = F.struct(clean_key(F.col("agent_id").cast("string")).alias("agent_id"), epoch_seconds(F.col("time").cast("string")).alias("s"))
    return (
        raw.select(F.col("ping_id").cast("bigint").alias("ping_id"), F.explode(F.array(key)).alias("k"), F.when(located, F.col("lng").cast("double")).alias("lng"), F.when(located, F.col("lat").cast("double")).alias("lat"))
        .where("k.agent_id is not null and k.s is not null")
        .select("ping_id", "k.agent_id", "k.s", "lng", "lat")
    )


def events(pings: DataFrame) -> DataFrame:
    """One row per agent and second: agent_id, s, lng, lat.

    Repeated deliveries of one second become one event; it is located if any
    delivery is (their positions agree; of differing ones the greatest pair is
    taken, so that the result doesn't depend on arrival).
    """
    return pings.groupBy("agent_id", "s").agg(_position()).select("agent_id", "s", F.col("at.lng").alias("lng"), F.col("at.lat").alias("lat"))


def _position() -> Column:
    return F.max(F.when(F.col("lng").isNotNull(), F.struct("lng", "lat"))).alias("at")


def by_day(pings: DataFrame, before_s: int = 0, after_s: int = 0) -> DataFrame:
    """Pings with ``day``, shuffled once on (agent_id, day).

    A day also gets the pings of the last ``before_s`` seconds before it and of
    the first ``after_s`` seconds behind it, its halo.
    """
    at = lambda c: F.floor(c / DAY_S).cast("bigint")
    if before_s or after_s:
        day = F.explode(F.sequence(at(F.col("s") - after_s), at(F.col("s") + before_s)))
    else:
        day = at(F.col("s"))
    return pings.withColumn("day", day).repartition("agent_id", "day")


def day_events(raw: DataFrame, before_s: int = 0, after_s: int = 0) -> DataFrame:
    """One row an event of a day or of its halo: agent_id, day, s, lng, lat, partitioned by (agent_id, day)."""
    rows = by_day(usable_pings(raw), before_s, after_s).groupBy("agent_id", "day", "s").agg(_position())
    return rows.select("agent_id", "day", "s", F.col("at.lng").alias("lng"), F.col("at.lat").alias("lat"))


def day_packs(raw: DataFrame, halo_s: int = 0) -> DataFrame:
    """agent_id, day, s, lng, lat, ping_ids: one row a day and its halo, arrays of its deliveries in any order.

    lng and lat are null in deliveries without a position.  A day has at most
    86,400 events, so a device that never pauses, or an agent with a third of all
    rows, is spread over its days.
    """
    e = F.collect_list(F.struct("s", "lng", "lat", "ping_id"))
    packed = by_day(usable_pings(raw), halo_s, halo_s).groupBy("agent_id", "day").agg(e.alias("e"))
    return packed.select("agent_id", "day", F.col("e.s").alias("s"), F.col("e.lng").alias("lng"), F.col("e.lat").alias("lat"), F.col("e.ping_id").alias("ping_ids"))
