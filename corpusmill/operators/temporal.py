"""Joins and neighbours in time, cut into slots so that no task gets a whole hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping_pairs(rows: DataFrame, row: str, keys: list[str], start: str, end: str, slot: int) -> DataFrame:
    """``a, b`` (``a < b``) of the rows of one key whose closed intervals of bigints share a point.

    Each interval enters the slots of length ``slot`` that it touches, and a pair
    is kept in the first slot that both touch, so nothing is made distinct. A
    null start or end is open: the least start or the largest end of all rows.
    An interval that ends before it starts, and a null key, have no pairs.
    """
    r = rows.select(F.col(row).alias("id"), *keys, F.col(start).alias("s"), F.col(end).alias("e"))
    ends = r.agg(F.min(F.least("s", "e")).alias("lo"), F.max(F.greatest("s", "e")).alias("hi"))
    r = r.crossJoin(ends).select("id", *keys, F.coalesce("s", "lo").alias("s"), F.coalesce("e", "hi").alias("e")).where("s <= e")
    r = r.withColumn("first", F.floor(F.col("s") / slot)).withColumn("at", F.explode(F.sequence(F.floor(F.col("s") / slot), F.floor(F.col("e") / slot))))
    x, y = r.alias("x"), r.alias("y")
    same = F.col("x.at") == F.col("y.at")
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    meets = (F.col("x.s") <= F.col("y.e")) & (F.col("y.s") <= F.col("x.e")) & (F.col("x.at") == F.greatest("x.first", "y.first"))
    return x.join(y, same & (F.col("x.id") < F.col("y.id")) & meets).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, slot: int, strict: bool = False) -> DataFrame:
    """``left`` with ``at_right`` and ``value`` of the latest row of ``right`` of its key that is not later (with ``strict``, earlier).

    ``at`` is a bigint in both, ``value`` a column of ``right``; of rows at one
    time the largest value counts. Rows of ``left`` without such a row have nulls;
    a null key or time finds nothing. What a slot of time doesn't hold is carried
    over from the last earlier slot by one row a key and slot.
    """
    l = left.withColumn("_slot", F.floor(F.col(at) / slot))  # noqa: E741
    r = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_k"), F.col(at).alias("_t")).agg(F.max(value).alias("_v")).withColumn("_slot", F.floor(F.col("_t") / slot))
    found = F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))
    both = l.select(F.struct(*left.columns).alias("_l"), F.col(key).alias("_k"), F.col(at).alias("_t"), "_slot", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(0 if strict else 1).alias("_o")).unionByName(
        r.select(F.lit(None).cast(F_struct(left)).alias("_l"), "_k", "_t", "_slot", "_v", F.lit(1 if strict else 0).alias("_o")))
    w = Window.partitionBy("_k", "_slot").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.last(F.when(F.col("_l").isNull(), found), True).over(w)).where("_l is not null")
    last = r.groupBy("_k", "_slot").agg(F.max(found).alias("_last"))
    need = inside.where("_in is null").select("_k", "_slot").distinct()
    order = Window.partitionBy("_k").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.join(need, ["_k", "_slot"], "full").withColumn("_before", F.last("_last", True).over(order)).select("_k", "_slot", "_before")
    out = inside.join(carried, ["_k", "_slot"], "left")
    best = F.coalesce("_in", "_before")
    return out.select("_l.*", best["t"].alias("at_right"), best["v"].alias(value))


def F_struct(df: DataFrame) -> str:
    return df.schema.simpleString()


def next_within(rows: DataFrame, row: str, keys: list[str], at: str, within: int) -> DataFrame:
    """``a, b, gap``: every row with the next one of its keys that is at most ``within`` later (by time, then id).

    Times are bigints. A row stands in its slot of length ``within`` and, to be
    found, in the one before, so that every window is one key's rows of two slots.
    Null keys are keys; null times are left out.
    """
    r = rows.where(F.col(at).isNotNull()).select(F.col(row).alias("a"), *keys, F.col(at).alias("t")).withColumn("slot", F.floor(F.col("t") / within))
    r = r.select("a", *keys, "t", "slot", F.explode(F.array("slot", F.col("slot") - 1)).alias("in"))
    w = Window.partitionBy(*keys, "in").orderBy("t", "a")
    s = r.withColumn("b", F.lead("a").over(w)).withColumn("gap", F.lead("t").over(w) - F.col("t"))
    return s.where((F.col("slot") == F.col("in")) & (F.col("gap") <= within)).select("a", "b", "gap")
