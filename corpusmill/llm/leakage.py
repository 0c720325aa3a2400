"""Evaluation passages inside a training corpus.

Texts are compared by their letters and digits in lower case. A shared run of
``RUN`` characters is one window of that length, standing in both. Containment
of an item in a document is searched by MinHash with both sides partitioned to
one size: whatever their lengths, both are taken as windows of one run, and
between windows of one size containment is equality of sets, so that the
MinHash of a window's shingles (half a window long) is the same on both sides
wherever a run is shared. One permutation misses nothing; the windows found are
then verified by exact containment of the run. (Signatures of whole items and
whole documents would not do: a run of 40 characters may be a hundredth of an
item, and a millionth of a document.)

The index of a block of items is built once: the sorted minima of all windows,
the windows by their hash, and the text itself for the exact check, in arrays
of at most ``BYTES_A_CHAR`` bytes a character that every task reads.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 40
#: Characters of items in one block; a larger test set takes one pass over the corpus a block.
BLOCK_CHARS = 4_000_000
#: Bytes of the index for each of them: a minimum, a window's hash and place, and the character.
BYTES_A_CHAR = 24
#: Characters hashed at a time; a longer text is taken in parts that overlap by a run.
PART_CHARS = 300_000

_OTHER = re.compile(r"[\W_]+")


def bare(text: str) -> str:
    """Letters and digits of ``text`` in lower case."""
    return _OTHER.sub("", text.lower())


def window_minima(codes, run: int):  # noqa: ANN001, ANN201
    """The MinHash of the window that starts at each place of an array of code points."""
    import numpy as np

    def power(base: int, n: int) -> "np.uint64":
        return np.uint64(pow(base, n, 1 << 64))

    shingle = run // 2
    base = 0x9E3779B97F4A7C15 | 1
    h = codes.astype(np.uint64)
    h = (h + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    spans, n = {1: h}, 1
    while n * 2 <= shingle:
        spans[n * 2] = spans[n][:-n] * power(base, n) + spans[n][n:] if len(spans[n]) > n else spans[n][:0]
        n *= 2
    out, done = None, 0
    for n in sorted(spans, reverse=True):
        if done + n <= shingle:
            out = spans[n] if out is None else out[: len(out) - n] * power(base, n) + spans[n][done:][: len(out) - n] if len(out) > n else out[:0]
            done += n
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(30)
    width, least, n = run - shingle + 1, out, 1
    while n * 2 <= width:
        least = np.minimum(least[:-n], least[n:]) if len(least) > n else least[:0]
        n *= 2
    rest = width - n
    return np.minimum(least[:-rest], least[rest:]) if rest and len(least) > rest else least[:0] if rest else least


def _codes(text: str):  # noqa: ANN202
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


class Items:
    """The windows of the passages of one block."""

    def __init__(self, passages: list[tuple[int, str]], run: int):
        import numpy as np

        self.run = run
        kept = [(i, b) for i, p in passages if len(b := bare(p)) >= run]
        self.ids = np.array([i for i, _ in kept], np.int64)
        codes = [_codes(b) for _, b in kept]
        self.ends = np.cumsum([len(c) for c in codes], dtype=np.int64)
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        self.minima = np.unique(np.concatenate([window_minima(c, run) for c in codes])) if codes else np.zeros(0, np.uint64)
        at = np.concatenate([np.arange(e - len(c), e - run + 1, dtype=np.int32) for c, e in zip(codes, self.ends, strict=True)]) if codes else np.zeros(0, np.int32)
        hashes = self.hashes(self.codes, at)
        order = np.argsort(hashes, kind="stable")
        self.windows, self.at = hashes[order], at[order]

    def hashes(self, codes, at):  # noqa: ANN001, ANN201
        """A hash of the window that starts at each of the places ``at``."""
        import numpy as np

        out = np.zeros(len(at), np.uint64)
        for k in range(self.run):
            out = (out + codes[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return out

    def holding(self, codes, places: "list[int]") -> "Iterator[tuple[int, int]]":  # noqa: ANN001
        """``(place, item)`` of the windows of ``codes`` at ``places`` that stand in an item, letter by letter."""
        import numpy as np

        h = self.hashes(codes, np.asarray(places, np.int64))
        low, high = np.searchsorted(self.windows, h, "left"), np.searchsorted(self.windows, h, "right")
        for p, a, b in zip(places, low.tolist(), high.tolist(), strict=True):
            for q in self.at[a:b].tolist():
                if np.array_equal(codes[p : p + self.run], self.codes[q : q + self.run]):
                    yield p, int(self.ids[np.searchsorted(self.ends, q, "right")])


def _search(texts: list[str], items: Items) -> list[tuple[int, int]]:
    """``(index, item)`` of every text and item that share a run."""
    import numpy as np

    run, minima = items.run, items.minima
    found: set[tuple[int, int]] = set()
    parts: list[tuple[int, str]] = []
    size = 0

    def flush() -> None:
        if not parts or not len(minima):
            return
        ends = np.cumsum([len(p) for _, p in parts])
        codes = _codes("".join(p for _, p in parts))
        least = window_minima(codes, run)
        at = np.searchsorted(minima, least)
        hits = np.flatnonzero(minima[np.minimum(at, len(minima) - 1)] == least)
        owner = np.searchsorted(ends, hits, side="right")
        inside = hits + run <= ends[np.minimum(owner, len(ends) - 1)]
        for p, item in items.holding(codes, hits[inside].tolist()):
            found.add((parts[int(np.searchsorted(ends, p, side="right"))][0], item))

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - run + 1), PART_CHARS):
            part = text[start : start + PART_CHARS + run - 1]
            if len(part) >= run:
                parts.append((i, part))
                size += len(part)
                if size >= PART_CHARS:
                    flush()
                    parts, size = [], 0
    flush()
    return sorted(found)


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", run: int = RUN) -> DataFrame:
    """``doc_id, item_id`` of every document and item whose letters and digits share a run of at least ``run`` characters.

    Null, empty and short texts and passages share nothing. Pairs are distinct,
    so repeated rows count once. Empty tables give no rows; columns not named
    are not read. The corpus is read once for every ``BLOCK_CHARS`` characters of
    passages, or one passage where it is longer; only the pairs found are
    shuffled, to make them distinct.
    """
    kept = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("p")).where("item_id is not null and p is not null")
    chars = kept.agg(F.sum(F.char_length("p"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = documents.select(F.col(doc_id).alias("doc_id")).schema.add(kept.schema["item_id"])
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).where("t is not null")
    out = None
    for b in range(blocks):
        block = Items([(r.item_id, r.p) for r in kept.where(F.expr(f"pmod(xxhash64(item_id), {blocks}) = {b}")).toLocalIterator()], run)
        index = documents.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator, index=index) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                ids, blobs = batch.column(0), batch.column(1)
                pairs = _search([bare(x.decode("utf-8", "replace")) for x in blobs.to_pylist()], index.value)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in pairs], pa.int64())), pa.array([e for _, e in pairs], pa.int64())], names=["doc_id", "item_id"])

        part = rows.mapInArrow(search, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
