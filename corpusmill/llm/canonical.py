"""Mapping of hand-typed values to the entries of a reference list.

The spellings of the list (terms and aliases) form a trie. A value walks it
with the states of a Levenshtein automaton: one row of edit distances per trie
node, cut off where the whole row exceeds the slips that are allowed, so that
one walk meets every spelling within reach. A slip is one character added,
lost or changed, or two neighbours swapped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut, evenly

#: Spellings held by one trie; a longer list is searched in blocks of this size.
BLOCK = 50_000


def bare(value: str) -> str:
    """Letters and digits of ``value`` without case and full-width forms."""
    folded = unicodedata.normalize("NFKC", value).lower()
    return "".join(c for c in folded if c.isalnum())


def slips(length: int) -> int:
    """The slips allowed for a spelling of so many letters and digits."""
    return 0 if length < 4 else 1 if length < 9 else 2


class Trie:
    """Spellings with the ids of their entries."""

    def __init__(self, spellings: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for text, entry in spellings:
            node = self.root
            for c in text:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((entry, len(text)))

    def within(self, value: str) -> list[tuple[int, int]]:
        """``(slips, entry)`` of every entry within its spelling's allowance, fewest first, then by id."""
        most = slips(len(value) + 2)  # no spelling that is within reach allows more
        n = len(value)
        found: dict[int, int] = {}
        stack = [(self.root, "", None, list(range(n + 1)), "")]
        while stack:
            node, c, before, row, last = stack.pop()
            for entry, length in node.get("", ()):
                if row[n] <= slips(length) and row[n] < found.get(entry, 9):
                    found[entry] = row[n]
            for d, child in node.items():
                if not d:
                    continue
                new = [row[0] + 1]
                for i in range(1, n + 1):
                    v = value[i - 1]
                    best = min(new[i - 1] + 1, row[i] + 1, row[i - 1] + (v != d))
                    if before is not None and i > 1 and v == c and value[i - 2] == d:
                        best = min(best, before[i - 2] + 1)
                    new.append(best)
                if min(new) <= most or min(row) < most:  # a swap reaches over one row
                    stack.append((child, d, row, new, c))
        return sorted((s, e) for e, s in found.items())


def candidates(values: DataFrame, entries: DataFrame, kind: str, value: str) -> DataFrame:
    """``kind, value, term_id, slips``: for every distinct value all entries of its kind within the allowance of their spelling.

    ``entries`` has ``term_id, kind, term, aliases``. Compared are letters and
    digits only, without case and full-width forms; an entry counts once, with
    the fewest slips of its term and aliases. Null values and kinds, values
    without a letter or digit, and null terms and aliases have no row; neither
    has anything where the list or the values are empty.

    Each distinct value is searched once, evenly over all tasks. The list goes
    to them in tries of at most ``BLOCK`` spellings each, one pass a block, so
    that no task holds more than that however long the list is.
    """
    spelled = entries.where("term_id is not null and kind is not null").select(
        F.col("term_id").cast("long").alias("term_id"), "kind", F.explode(F.array_distinct(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("s")
    ).where("s is not null").distinct()
    n = spelled.count()
    blocks = max(1, -(-n // BLOCK))
    once = values.select(F.col(kind).alias("kind"), F.col(value).alias("value")).where("kind is not null and value is not null").distinct().withColumn("part", F.xxhash64("kind", "value"))
    once = evenly(once, "part").select("kind", "value")
    if blocks > 1:
        once = cut(once)
    out = None
    for b in range(blocks):
        block = values.sparkSession.sparkContext.broadcast([(r.kind, r.s, r.term_id) for r in spelled.where(F.expr(f"pmod(xxhash64(kind, s), {blocks}) = {b}")).toLocalIterator()])

        def search(batches: Iterator, block=block) -> Iterator:
            import pyarrow as pa

            by_kind: dict[str, list] = {}
            for k, s, e in block.value:
                if text := bare(s):
                    by_kind.setdefault(k, []).append((text, e))
            tries = {k: Trie(found) for k, found in by_kind.items()}
            for batch in batches:
                found = []
                for i, (k, v) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                    if k in tries and (text := bare(v)):
                        found += [(i, e, s) for s, e in tries[k].within(text)]
                at = pa.array([i for i, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([e for _, e, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int32())], names=["kind", "value", "term_id", "slips"])

        part = once.mapInArrow(search, "kind string, value string, term_id bigint, slips int")
        out = part if out is None else out.unionByName(part)
    return out if blocks == 1 else out.groupBy("kind", "value", "term_id").agg(F.min("slips").alias("slips"))


def to_canonical(values: DataFrame, entries: DataFrame, kind: str, value: str) -> DataFrame:
    """``values`` with ``term_id`` (bigint): the entry of the same kind that the value equals with the fewest slips.

    Of ``candidates`` with equally few slips the smallest id wins. ``term_id`` is
    0 where there is none. A column named ``term_id`` in ``values`` is replaced.
    Every row stays, repeated rows included.
    """
    best = candidates(values, entries, kind, value).groupBy("kind", "value").agg(F.min(F.struct("slips", "term_id")).alias("_best")).select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), F.col("_best.term_id").alias("term_id"))
    rows = values.drop("term_id")
    out = rows.join(best, (F.col(kind) == F.col("_kind")) & (F.col(value) == F.col("_value")), "left")
    return out.select(*rows.columns, F.coalesce("term_id", F.lit(0).cast("long")).alias("term_id"))


def typed_values(notes: DataFrame, note_id: str = "note_id", domain: str = "domain", tags: str = "tags") -> DataFrame:
    """``note_id, field, raw_value``: one row per note and distinct domain or tag that has a letter or digit.

    Nulls, blanks and values without a letter or digit give no row.
    """
    value: Column = F.array_compact(F.array_distinct(F.coalesce(F.col(tags), F.array().cast("array<string>"))))
    rows = notes.select(F.col(note_id).alias("note_id"), F.explode(F.concat(
        F.array(F.struct(F.lit("domain").alias("field"), F.col(domain).alias("raw_value"))),
        F.transform(value, lambda t: F.struct(F.lit("tags").alias("field"), t.alias("raw_value"))),
    )).alias("_v")).select("note_id", "_v.*")
    return rows.where(F.col("raw_value").rlike(r"[\p{L}\p{N}]")).distinct()


def map_typed(notes: DataFrame, entries: DataFrame) -> DataFrame:
    """``note_id, field, raw_value, term_id`` of every typed value that is not literally a term of its kind."""
    rows = typed_values(notes).withColumn("kind", F.when(F.col("field") == "domain", "domain").otherwise("tag"))
    literal = entries.select("kind", F.col("term").alias("raw_value")).where("kind is not null and raw_value is not null").distinct()
    rows = rows.join(literal, ["kind", "raw_value"], "left_anti")
    return to_canonical(rows, entries, "kind", "raw_value").select("note_id", "field", "raw_value", "term_id")
