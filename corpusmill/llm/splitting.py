"""Oversized texts cut at natural boundaries, with overlap.

One regular expression takes as much as fits and ends at the strongest boundary
that the last part of it offers: its alternatives are ordered from a blank line
over a line end, a sentence end and a clause mark to white space, with a plain
cut last. Quantifiers count code points. All of it is SQL array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 500

def pattern(limit: int, overlap: int) -> str:
    """The expression of one core: at most ``limit`` code points at the start, ``limit - overlap`` after it."""

    def core(most: int) -> str:
        least = max(overlap, most // 2, 1)
        ends = (r"(?<=\n[ \t\r]{0,9}\n)(?=\S)", r"(?<=\n)", r"(?<=[。！？!?…][”’」』）)\"']?|\.)(?=\s|[^\x00-\x7f])", r"(?<=[；;，,、：:])", r"(?<=\s)(?=\S)")
        # in the second half of a core, then as early as an overlap allows, then anywhere
        return "|".join([rf".{{1,{most}}}\z", *(rf".{{{low},{most}}}{e}" for low in (least, max(overlap, 1)) for e in ends), rf".{{1,{most}}}"])

    return rf"(?s)\A(?:{core(limit)})|(?:{core(limit - overlap)})"


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of ``text`` as an array; null for null, one piece for a text within ``limit``."""
    cores = F.regexp_extract_all(text, F.lit(pattern(limit, overlap)), F.lit(0))
    # zipped with the core before it, so that the expression runs twice in all and not once a piece
    before = F.concat(F.array(F.lit("")), cores)
    joined = F.zip_with(cores, before, lambda c, b: F.when(c.isNotNull(), F.concat(F.substring(b, -overlap, overlap), c)))
    with_overlap = F.filter(joined, lambda x: x.isNotNull())
    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(with_overlap)


def split_oversized(items: DataFrame, text: str = "body", keep_whole: str | None = "is_parent_index", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The items longer than ``limit`` code points as pieces: their columns, with ``piece_no`` (from 1), ``n_pieces`` and ``piece``.

    Items whose ``keep_whole`` is true stay uncut and give no row; null is not
    true. Null and empty texts and those within the limit give no row. Every
    piece has at most ``limit`` characters, each but the first begins with the
    last ``overlap`` characters of the one before, and the pieces without these
    overlaps are the whole text. Columns of the input that are named as the
    result's are replaced. Repeated rows are cut each. ``overlap`` has to be
    less than half of ``limit``, so that a piece always holds its overlap.
    """
    if not 0 < overlap < limit / 2:
        raise ValueError("overlap has to be above 0 and less than half of limit")
    rows = items.drop("piece_no", "n_pieces", "piece").where(F.char_length(text) > limit)
    if keep_whole:
        rows = rows.where(~F.coalesce(F.col(keep_whole), F.lit(False)))
    rows = rows.withColumn("_pieces", pieces(F.col(text), limit, overlap))
    return rows.select(*[c for c in rows.columns if c != "_pieces"], F.size("_pieces").alias("n_pieces"), F.posexplode("_pieces").alias("piece_no", "piece")).withColumn("piece_no", F.col("piece_no") + 1)
