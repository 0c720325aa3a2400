"""Sessions of activity separated by gaps of inactivity.

Sweep line: every event opens the interval from its time to its time plus the
gap. Adding one at each opening and subtracting one at each closing, the
running sum falls to zero exactly where a session ends.

All events of one actor within one gap-long slot of time belong to one session,
so the events are first merged to one interval a slot (a map-side aggregate).
The sweep then sorts at most one interval per actor and slot: its partitions
are bounded by the time that the data spans, however many events one actor has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_SECONDS = 30 * 60


def clean_actor(name: Column) -> Column:
    """``name`` in lower case without surrounding white space; null when nothing is left."""
    bare = F.lower(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))
    return F.when(bare != "", bare)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp's clock time read as UTC: the same in every session zone for one without a zone."""
    return F.unix_micros(F.concat(at.cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp"))


def sessions(events: DataFrame, actor: str, at: str, event_id: str | None = None, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """One row per session: ``actor, start_time, end_time, duration_s, n_events``.

    An event more than ``gap_seconds`` after the actor's previous one opens a
    session; one exactly so long after it does not. Times are strings
    ``yyyy-MM-dd HH:mm:ss`` with fractions cut off; ``duration_s`` is a double with them.

    Actors are compared by ``clean_actor``. Rows without a time or with a null
    or blank actor don't count. Events of one ``event_id`` and time count once,
    null ids each by itself; without ``event_id`` every row counts. An empty
    input gives no rows, and other columns of the input are never read.
    """
    gap = gap_seconds * 1_000_000
    rows = events.select(
        clean_actor(F.col(actor)).alias("_actor"), micros(F.col(at)).alias("_t"), *([F.col(event_id).alias("_id")] if event_id else [])
    ).where("_actor is not null and _t is not null")
    rows = rows.withColumn("_slot", F.col("_t") if gap == 0 else F.expr(f"floor(_t div {gap}) - if(_t < 0 and _t % {gap} != 0, 1, 0)"))
    keys = ["_actor", "_slot"]
    if event_id:
        once = rows.groupBy(*keys, "_id", "_t").agg(F.count("*").alias("_n"))
        slots = once.groupBy(*keys).agg(
            F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(1)).alias("_n")
        )
    else:
        slots = rows.groupBy(*keys).agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"))
    deltas = slots.select("_actor", F.inline(F.array(
        F.struct(F.col("_from").alias("_p"), F.lit(1).alias("_d"), F.col("_from").alias("_first"), F.lit(None).cast("long").alias("_last"), F.col("_n").alias("_k")),
        F.struct((F.col("_to") + gap).alias("_p"), F.lit(-1).alias("_d"), F.lit(None).cast("long").alias("_first"), F.col("_to").alias("_last"), F.lit(0).cast("long").alias("_k")),
    )))
    # at one point openings come before closings: exactly one gap apart is the same session
    sweep = Window.partitionBy("_actor").orderBy(F.col("_p"), F.col("_d").desc())
    swept = deltas.withColumn("_open", F.sum("_d").over(sweep.rowsBetween(Window.unboundedPreceding, 0)))
    swept = swept.withColumn("_s", F.coalesce(F.sum(F.when(F.col("_open") == 0, 1).otherwise(0)).over(sweep.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    closed = swept.groupBy("_actor", "_s").agg(F.min("_first").alias("_a"), F.max("_last").alias("_b"), F.sum("_k").alias("n_events"))
    text = lambda c: F.substring(F.expr(f"cast(timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast({c} as decimal(24, 6)) / 1000000) as string)"), 1, 19)
    return closed.select(
        F.col("_actor").alias(actor), text("_a").alias("start_time"), text("_b").alias("end_time"), ((F.col("_b") - F.col("_a")) / F.lit(1e6)).alias("duration_s"), "n_events"
    )
