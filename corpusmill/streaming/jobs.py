"""Structured Streaming twins of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators.recall import Memory
from corpusmill.operators.sessions import clean_actor
from corpusmill.sources.tables import is_written


def session_stream(events: DataFrame, actor: str, at: str, event_id: str, late: str = "1 day", gap_seconds: int = 1800) -> DataFrame:
    """``actor, start_time, end_time, n_events`` of sessions that the watermark has closed; events later than ``late`` are dropped.

    ``at`` has to be a timestamp. An event that is delivered again within
    ``late`` counts once. ``session_window`` parts events exactly a gap apart or
    more; a microsecond is added, so that exactly the gap stays together.
    """
    rows = events.select(clean_actor(F.col(actor)).alias(actor), F.col(at).cast("timestamp").alias("at"), F.col(event_id).alias("_id")).where(f"{actor} is not null and at is not null")
    rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark([actor, "_id"])
    win = F.session_window("at", f"{gap_seconds} seconds 1 microsecond")
    out = rows.groupBy(actor, win).agg(F.min("at").alias("start_time"), F.max("at").alias("end_time"), F.count("*").alias("n_events"))
    return out.select(actor, "start_time", "end_time", "n_events")


def requery_stream(events: DataFrame, keys: list[str], event: str, at: str, within_seconds: int = 3600, late: str = "2 hours") -> DataFrame:
    """``a, b, seconds``: every event with the next of its keys within the time, each as soon as the next one is there.

    State is the last event of each key; it goes when nothing can follow it any
    more. Within a micro-batch events are taken in order of time; an event that
    arrives later than one after it has been seen starts anew.
    """
    import pandas as pd

    rows = events.select(*keys, F.col(event).cast("long").alias("e"), F.col(at).cast("timestamp").alias("at")).where("at is not null").withWatermark("at", late)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values(["at", "e"])
        last = state.get if state.exists else None
        out = []
        for e, t in zip(pdf["e"], pdf["at"].astype("int64") // 1000, strict=True):
            if last == (e, t):  # delivered again
                continue
            if last is not None and 0 <= t - last[1] <= within_seconds * 1_000_000:
                out.append((last[0], int(e), (t - last[1]) // 1_000_000))
            if last is None or t >= last[1]:
                last = (int(e), int(t))
        state.update(last)
        state.setTimeoutTimestamp(max(last[1] // 1000 + within_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["a", "b", "seconds"])

    return rows.groupBy(*keys).applyInPandasWithState(run, "a long, b long, seconds long", "e long, t long", "append", GroupStateTimeout.EventTimeTimeout)


def recall_stream(reviews: DataFrame, item: str, day: str, grade: str) -> DataFrame:
    """``item, stability, difficulty, reps, lapses`` of every item reviewed in a micro-batch; state is kept by item, reviews of one batch are taken by day and grade."""
    import pandas as pd

    rows = reviews.select(F.col(item).alias("item"), F.col(day).cast("double").alias("day"), F.col(grade).cast("int").alias("grade")).where("item is not null and day is not null and grade is not null")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["day", "grade"])
        now, last = (Memory(*state.get[:4]), state.get[4]) if state.exists else (Memory(), None)
        for d, g in zip(pdf["day"], pdf["grade"], strict=True):
            now, last = now.after(int(g), 0.0 if last is None else float(d) - last), float(d)
        state.update((*now, last))
        yield pd.DataFrame([(key[0], *now)], columns=["item", *Memory._fields])

    kind = dict(rows.dtypes)["item"]
    return rows.groupBy("item").applyInPandasWithState(run, f"item {kind}, stability double, difficulty double, reps long, lapses long", "stability double, difficulty double, reps long, lapses long, day double", "update", GroupStateTimeout.NoTimeout)


def changed_texts(incoming: DataFrame, stored: DataFrame, row: str, text: str) -> DataFrame:
    """Rows of ``incoming`` that ``stored`` (``row, sha``) doesn't have with this text, with ``sha``; the last by text of equal ids."""
    now = incoming.withColumn("sha", F.sha2(F.coalesce(text, F.lit("")), 256)).groupBy(row).agg(F.max(F.struct("sha", text)).alias("v")).select(row, "v.*")
    return now.join(stored.select(F.col(row), "sha"), [row, "sha"], "left_anti")


def upsert_batches(folder: str, row: str, text: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps a table of texts by id in versions ``folder/v=N``: a batch writes what it changes next to what stays.

    Version N is made of version N-1 and batch N only, so that a batch that is
    run again writes the same. ``read_upserted`` reads the last version.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = _version(spark, folder, number - 1)
        stored = old if old is not None else batch.limit(0).select(row, text).withColumn("sha", F.lit(None).cast("string"))
        new = changed_texts(batch.select(row, text), stored, row, text)
        stored.join(new.select(row), row, "left_anti").select(row, text, "sha").unionByName(new.select(row, text, "sha")).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return run


def _version(spark, folder: str, number: int):  # noqa: ANN001, ANN202
    """The last whole version up to ``number``; None where there is none. A read that fails is an error."""
    while number >= 0 and not is_written(spark, f"{folder}/v={number}"):
        number -= 1
    return spark.read.parquet(f"{folder}/v={number}") if number >= 0 else None


def read_upserted(spark, folder: str, number: int) -> DataFrame:  # noqa: ANN001
    """The table after batch ``number``."""
    return _version(spark, folder, number)
