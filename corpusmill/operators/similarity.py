"""Similarity joins of sets and of vectors.

The join of sets orders the elements of a set from the rarest to the most
frequent in the corpus and keeps a prefix: so much that two rows that are
similar enough have to share an element of both prefixes. Only rows that meet
there are scored. Prefixes hold rare elements, so no frequent one is ever a
join key unless a row has nothing else. The join of vectors multiplies blocks (``bags``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators import bags
from corpusmill.sources.tables import cut, evenly

#: Rows of one key that meet in one group; the pairs of a larger key are parted into blocks of so many.
MEET = 4000


def in_blocks(rows: DataFrame, key: str, row: str, most: int = MEET) -> DataFrame:
    """``rows`` for a join with themselves on ``key, _a, _b`` under ``once``: no group has many more than ``2 * most`` rows, however many have the key.

    A key of more than ``most`` rows is cut into blocks by the hash of the row;
    each row enters every pair of blocks that its own is part of. The groups are
    spread over as many partitions as the session shuffles into: the rows are few
    and their pairs many, so that partitions merged by bytes would leave the
    pairs to a few tasks.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_m"))
    rows = rows.join(n, key).withColumn("_k", F.ceil(F.col("_m") / most)).withColumn("_own", F.pmod(F.xxhash64(row), F.col("_k")))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
    return evenly(rows.withColumn("_a", F.least("_own", "_j")).withColumn("_b", F.greatest("_own", "_j")).drop("_m", "_k", "_j"), key, "_a", "_b")


def once(key: str) -> Column:
    """Whether rows ``p`` and ``q`` of ``in_blocks`` meet, each pair in one group only."""
    same = lambda c: F.col(f"p.{c}") == F.col(f"q.{c}")
    return same(key) & same("_a") & same("_b") & (~same("_own") | (F.col("p._a") == F.col("p._b")))


def jaccard_pairs(sets: DataFrame, row: str, items: str, least: float) -> DataFrame:
    """``a, b, shared, jaccard, containment`` of every pair of rows with Jaccard at least ``least``; ``a < b``.

    ``items`` is an array without repeats (of hashes, best). Rows with a null or
    empty set have no pairs; ids have to be unique. Containment is by the smaller set.
    """
    s = cut(sets.select(F.col(row).alias("id"), F.col(items).alias("s")).where(F.size("s") > 0))
    each = s.select("id", F.size("s").alias("n"), F.explode("s").alias("x"))
    freq = each.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    # an element that stands in one row only joins nothing, but still takes its place in the order: before all others
    ranked = each.join(freq, "x").select("id", "n", "x", "df")
    w = Window.partitionBy("id").orderBy("df", "x")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("id"))
    length = F.col("n") - F.ceil(F.round(F.col("n") * least, 9)) + 1
    prefix = ranked.withColumn("at", F.row_number().over(w) + alone).where(F.col("at") <= length).select("id", "n", "x")
    prefix = in_blocks(prefix, "x", "id")
    p, q = prefix.alias("p"), prefix.alias("q")
    fits = (F.col("p.n") >= F.round(F.col("q.n") * least, 9)) & (F.col("q.n") >= F.round(F.col("p.n") * least, 9))
    met = p.join(q, once("x") & (F.col("p.id") < F.col("q.id")) & fits).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")).distinct()
    both = met.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).withColumn("jaccard", F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared")))
    return both.where(F.col("jaccard") >= least).select("a", "b", F.col("shared").cast("long").alias("shared"), "jaccard", (F.col("shared") / F.least(F.size("sa"), F.size("sb"))).alias("containment"))


def cosine_pairs(weights: DataFrame, least: float) -> DataFrame:
    """``a, b, cosine`` of every pair of documents with cosine at least ``least`` (above 0); ``a < b``.

    ``weights`` has ``doc, term, w`` with one row a term and positive weights; ids
    are bigints. How documents meet is told at ``bags.alike``.
    """
    each = weights.select("doc", F.xxhash64("term").alias("h"), "w")
    shared = each.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    rows = each.groupBy("doc").agg(F.collect_list(F.struct("h", "w")).alias("x")).select("doc", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    return bags.alike(bags.in_blocks(rows, bags.dictionary(shared)), least)


def hashed(items: Column) -> Column:
    """A set of strings as a set of 64-bit hashes."""
    return F.array_distinct(F.transform(items, lambda x: F.xxhash64(x)))
