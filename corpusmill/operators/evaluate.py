"""Thresholds, intervals and trends of measured results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_sweep(scored: DataFrame, score: str, truth: str, low: int, high: int, step: int) -> DataFrame:
    """``threshold, precision, recall, f1`` for thresholds of hundredths from ``low`` to ``high``; a score counts from the threshold on.

    Scores are counted by the hundredth below them first; the grid meets those
    counts only. Null scores are never found, null truths are false. A measure
    without a denominator is 0.
    """
    bins = scored.select(F.floor(F.round(F.col(score) * 100, 6)).alias("b"), F.coalesce(F.col(truth), F.lit(False)).alias("y"))
    total = bins.agg(F.coalesce(F.sum(F.col("y").cast("long")), F.lit(0)).alias("pos"))
    bins = bins.where("b is not null").groupBy("b").agg(F.sum(F.col("y").cast("long")).alias("tp"), F.count("*").alias("n"))
    grid = scored.sparkSession.range(low, high + 1, step).select(F.col("id").alias("t"))
    m = grid.join(bins, bins["b"] >= grid["t"], "left").groupBy("t").agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).crossJoin(total)
    p = F.when(F.col("n") > 0, F.col("tp") / F.col("n")).otherwise(0.0)
    r = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    return m.select((F.col("t") / 100).alias("threshold"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


#: Cumulative shares of the counts 0 to 5 of a Poisson distribution of mean 1.
POISSON = (0.3679, 0.7358, 0.9197, 0.9810, 0.9963, 0.9994)
#: The prime that draws are made below.
PRIME = 2_147_483_647


def bootstrap_interval(values: DataFrame, value: str, row: str, rounds: int = 200) -> DataFrame:
    """One row ``mean, low, high``: the mean and the 2.5 and 97.5 percentile of means of samples drawn with replacement.

    Each row is drawn a Poisson(1) number of times a round, by a number made of
    its id ``row`` (a bigint) and the round: the same whatever the partitions and
    however often a task runs. No sample is collected; a row's rounds are added
    up within its task first. Null values and ids are left out.
    """
    v = values.where(F.col(value).isNotNull() & F.col(row).isNotNull()).select(F.col(value).cast("double").alias("v"), F.pmod(F.col(row).cast("long"), F.lit(PRIME)).alias("i"))

    x = (F.col("i") * 48_271 + (F.col("k") + 1) * 1_234_567) % PRIME
    drawn = v.select("v", "i", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("k")).select("v", "k", ((x * x) % PRIME / PRIME).alias("u"))
    drawn = drawn.withColumn("w", sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON[1:]), F.when(F.col("u") >= POISSON[0], 1).otherwise(0)))
    means = drawn.groupBy("k").agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    s = F.array_sort(F.collect_list("m"))
    low, high = F.get(s, F.lit(max(1, round(rounds * 0.025)) - 1)), F.get(s, F.lit(round(rounds * 0.975) - 1))
    return v.agg(F.avg("v").alias("mean")).crossJoin(means.agg(low.alias("low"), high.alias("high")))


def trailing_run(rows: DataFrame, key: str, order: list[str], bad: str) -> DataFrame:
    """``key, run``: how many rows at the end of each key's order are bad without a good one among them; 0 where the last is good.

    The last good place is an aggregate, the rows after it are counted; nothing is sorted.
    """
    place = F.struct(*order)
    last = rows.groupBy(key).agg(F.max(F.when(~F.col(bad), place)).alias("_good"))
    after = rows.join(last, key).where(F.col("_good").isNull() | (place > F.col("_good"))).groupBy(key).agg(F.count("*").alias("run"))
    return last.select(key).join(after, key, "left").select(key, F.coalesce("run", F.lit(0).cast("long")).alias("run"))


def trend(rows: DataFrame, at: str, unit: str, value: str, alert: float) -> DataFrame:
    """``period, n, mean, delta, alert``: the mean of each day, ISO week or month (``unit``), by its first day, its difference to the one before, and whether that is at least ``alert``. Null times are left out."""
    p = rows.where(F.col(at).isNotNull()).groupBy(F.date_trunc(unit, at).cast("date").cast("string").alias("period")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    p = p.withColumn("delta", F.col("mean") - F.lag("mean").over(Window.orderBy("period")))
    return p.select("period", "n", F.round("mean", 6).alias("mean"), F.round("delta", 6).alias("delta"), F.coalesce(F.abs(F.round("delta", 6)) >= alert, F.lit(False)).alias("alert"))
