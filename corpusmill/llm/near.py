"""Near-duplicate texts by multi-index hashing, and their groups.

The fingerprints, their Hamming balls and the verification are those of
``operators/sketches.py``. Exact copies are collapsed to a class before any of
this, so that a group of copies enters the table once, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.graph import components
from corpusmill.operators.sketches import SEGMENTS, SYMBOLS, classes, near_texts
from corpusmill.sources.tables import cut

WINDOW, LEAST, LONGER_THAN = 5, 0.7, 200
#: Copies of a text that are expanded to pairs of rows; more are given as pairs with the first of them.
COPIES = 1000


def squeezed(text: Column) -> Column:
    """``text`` in lower case without white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def near_classes(texts: DataFrame, text_id: str = "note_id", text: str = "body", least: float = LEAST, window: int = WINDOW, longer_than: int = LONGER_THAN, segments: int = SEGMENTS, symbols: int = SYMBOLS) -> tuple[DataFrame, DataFrame]:
    """Members ``id, rep, n`` of classes of equal texts, and the pairs ``a, b, score`` of representatives at least ``least`` similar, ``a < b``.

    Texts are compared in lower case without white space, by the shares of
    their distinct windows of ``window`` characters. Null texts and those of at
    most ``longer_than`` characters take no part. An id that is repeated with one
    text counts once. Empty tables give no rows; other columns are not read.
    """
    rows = texts.select(F.col(text_id).cast("long").alias("id"), squeezed(F.col(text)).alias("t"))
    members, first = classes(rows.where(F.col("id").isNotNull() & (F.char_length("t") > longer_than)))
    return members, near_texts(first, least, window, segments, symbols).drop("containment")


def near_pairs(texts: DataFrame, text_id: str = "note_id", text: str = "body", copies: int = COPIES, **options: float) -> DataFrame:
    """``a, b, score`` of every pair of rows at least ``least`` similar, ``a < b``; copies have score 1.

    Classes of up to ``copies`` equal texts are expanded to pairs of rows. A
    larger one is given by its first row, which stands for it in pairs with
    other texts, and by the pairs of this row with each of its copies: no link
    between different texts and no copy is lost, but a group of copies costs no
    more than its size. Else as ``near_classes``.
    """
    members, links = near_classes(texts, text_id, text, **options)
    of = members.where((F.col("n") <= copies) | (F.col("id") == F.col("rep"))).select("id", "rep", "n")
    x, y = of.select(F.col("id").alias("x"), F.col("rep").alias("a")), of.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    between = links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score")
    small = members.where(F.col("n").between(2, copies))
    within = small.select(F.col("id").alias("a"), "rep").join(small.select(F.col("id").alias("b"), "rep"), "rep").where("a < b").select("a", "b")
    large = members.where((F.col("n") > copies) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("id").alias("b"))
    return between.unionByName(within.unionByName(large).withColumn("score", F.lit(1.0)))


def near_groups(texts: DataFrame, text_id: str = "note_id", text: str = "body", **options: float) -> DataFrame:
    """``text_id, class_id, group_id, n_copies, n_links`` of every row that takes part: its class of equal texts, the smallest id that links lead to, and its text's links to other texts."""
    members, links = near_classes(texts, text_id, text, **options)
    links = cut(links)
    groups = components(links, "a", "b")
    count = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("k"))
    out = members.join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").join(count, "rep", "left")
    return out.select(F.col("id").alias(text_id), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.col("n").alias("n_copies"), F.coalesce("k", F.lit(0).cast("long")).alias("n_links"))
