"""Chunks of texts at paragraphs: a fold over paragraphs, which Spark has no function for."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 2000, 500


def _blocks(text: str) -> Iterator[str]:
    """Parts of a text that belong together: paragraphs, headings, and code fences with whatever is in them; blank lines and rules end a part, rules stay with it."""
    held: list[str] = []
    fence = ""
    for line in text.split("\n"):
        mark = re.match(r"\s{0,3}(`{3,}|~{3,})", line)
        if fence:
            held.append(line)
            if mark and mark[1].startswith(fence) and not line.strip(" \t\r`~"):
                yield "\n".join(held)
                held, fence = [], ""
            continue
        opens, heading = bool(mark), bool(re.match(r"#{1,6}\s", line))
        if held and (opens or heading or not line.strip()):
            yield "\n".join(held)
            held = []
        if not line.strip():
            continue
        held.append(line)
        if opens:
            fence = mark[1]
        elif heading or re.fullmatch(r"\s{0,3}([-*_])(?:\s*\1){2,}\s*", line):
            yield "\n".join(held)
            held = []
    if held:
        yield "\n".join(held)


def _paragraphs(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs, a heading with what follows it; one longer than ``size`` cut at sentence ends or, without any, by length."""
    out: list[str] = []
    for block in _blocks(text):
        if out and re.fullmatch(r"#{1,6}\s.*", out[-1].strip()) and len(out[-1]) + len(block) + 2 <= size:
            out[-1] += "\n\n" + block
            continue
        while len(block) > size:
            cut = max((m.end() for m in re.finditer(r"[。！？.!?\n]", block[:size])), default=0)
            cut = cut if cut > overlap else size
            out.append(block[:cut])
            block = block[cut:]
        if block:
            out.append(block)
    return out


def _chunks(text: str, size: int, overlap: int) -> list[str]:
    """Paragraphs put together up to ``size``; each chunk but the first starts with the last paragraphs of the one before that are at most ``overlap`` together."""
    out: list[str] = []
    held: list[str] = []
    fresh = 0
    for p in _paragraphs(text, size, overlap):
        while held and sum(map(len, held)) + 2 * len(held) + len(p) > size:
            if fresh:
                out.append("\n\n".join(held))
                back: list[str] = []
                while held and sum(map(len, back)) + len(held[-1]) <= overlap:
                    back.insert(0, held.pop())
                held, fresh = back, 0
            else:
                held.pop(0)
        held.append(p)
        fresh += 1
    if fresh:
        out.append("\n\n".join(held))
    return out


def paragraph_chunks(texts: DataFrame, row: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``row, chunk_no, chars, chunk``: every text in chunks of at most ``size`` characters at paragraphs, numbered from 1.

    Null and blank texts have no chunk; a short text is one. Repeated rows are cut each.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at, no, chunk = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, c in enumerate(_chunks(t, size, overlap), 1):
                    at.append(i)
                    no.append(k)
                    chunk.append(c)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int64()), pa.array([len(c) for c in chunk], pa.int64()), pa.array(chunk, pa.string())], names=[row, "chunk_no", "chars", "chunk"])

    kind = dict(texts.dtypes)[row]
    return texts.where(F.col(text).isNotNull()).select(row, text).mapInArrow(run, f"{row} {kind}, chunk_no bigint, chars bigint, chunk string")


#: Sizes at which a note is put together with others, kept whole, or cut at its headings; a longer one is cut by meaning.
ROUTES = (200, 2000, 10_000)


def routed_chunks(texts: DataFrame, row: str, text: str) -> DataFrame:
    """``row, route, chunk_no, chars, chunk`` of every text by its size: whole below ``ROUTES[0]`` (aggregate) and up to ``ROUTES[1]`` (direct), at second-level headings up to ``ROUTES[2]`` (headings), else by ``paragraph_chunks`` (semantic).

    Null and blank texts have no chunk; neither has a blank piece.
    """
    n = F.char_length(text)
    t = texts.where(F.col(text).rlike(r"\S")).select(row, text, F.when(n < ROUTES[0], "aggregate").when(n <= ROUTES[1], "direct").when(n <= ROUTES[2], "headings").otherwise("semantic").alias("route"))
    parts = F.filter(F.when(F.col("route") == "headings", F.split(text, r"\n(?=## )")).otherwise(F.array(text)), lambda x: x.rlike(r"\S"))
    whole = t.where("route <> 'semantic'").select(row, "route", F.posexplode(parts).alias("i", "chunk")).select(row, "route", (F.col("i") + 1).cast("long").alias("chunk_no"), F.char_length("chunk").cast("long").alias("chars"), "chunk")
    return whole.unionByName(paragraph_chunks(t.where("route = 'semantic'"), row, text).withColumn("route", F.lit("semantic")))
