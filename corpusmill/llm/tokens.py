"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A longer text is cut at safe boundaries into stretches of about this many characters.
STRETCH = 100_000
#: Ids of one batch of results.
BATCH_IDS = 1_000_000
#: Where the pre-splitting pattern always splits, whatever stands around: before white space that
#: follows something else, and between a letter or digit and a mark after it that is no apostrophe.
SAFE = r"(?<=\S)(?=\s)|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}'])"


def load(path: str, pattern: str):  # noqa: ANN201
    """The encoding of a local rank file: lines of a base64 token and its id."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """``text`` in pieces whose ids, put together, are those of the whole; a piece ends at the first safe boundary from ``size`` on."""
    import regex

    safe = regex.compile(SAFE)
    start = 0
    while len(text) - start > size:
        cut = safe.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(texts: DataFrame, text: str = "text", ranks: str | None = None, pattern: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """``texts`` with ``ids`` (array<bigint>) instead of ``text``: the token ids of each text, without special tokens.

    ``ranks`` is the path of a rank file that every executor can read, by
    default that of the vocabulary byte_bpe_50k of ``public_tokenizers``;
    ``pattern`` splits a text before its merges. Null and empty texts give an
    empty list. The spelling of a special token in a text is ordinary text.
    Bytes that are no UTF-8 count as U+FFFD. Texts of any length are encoded
    whole. Every row stays, repeated rows too; a column ``ids`` is replaced.

    One pass without a shuffle; ids move as Arrow lists and never as Python numbers.
    """
    kept = [c for c in texts.columns if c not in (text, "ids")]
    rows = texts.select(*(F.col(f"`{c}`") for c in kept), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import public_tokenizers
        import pyarrow as pa

        encoding = load(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        for batch in batches:
            found, ends, total, first = [], [], 0, 0
            blobs = batch.column(len(kept))
            for i in range(len(blobs)):
                whole = blobs[i].as_buffer().to_pybytes().decode("utf-8", "replace")
                if len(whole) <= stretch:
                    ids = [encoding.encode_to_numpy(whole, disallowed_special=())] if whole else []
                else:
                    ids = [encoding.encode_to_numpy(s, disallowed_special=()) for s in stretches(whole, stretch)]
                found += ids
                total += sum(map(len, ids))
                ends.append(total)
                if total >= BATCH_IDS or i == len(blobs) - 1:
                    values = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.array([0, *ends], np.int32)), pa.array(values))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, i + 1 - first) for k in range(len(kept))), lists], names=[*kept, "ids"])
                    found, ends, total, first = [], [], 0, i + 1

    schema = rows.drop("_bytes").schema.add("ids", T.ArrayType(T.LongType()))
    return rows.mapInArrow(run, schema)


def decode(ids: DataFrame, ranks: str | None = None) -> DataFrame:
    """``ids`` with ``text`` instead of the column ``ids``: the tokens' raw bytes put together, read as UTF-8; null for null."""
    kept = [c for c in ids.columns if c not in ("ids", "text")]
    rows = ids.select(*(F.col(f"`{c}`") for c in kept), "ids")

    def run(batches: Iterator) -> Iterator:
        import public_tokenizers
        import pyarrow as pa

        encoding = load(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        for batch in batches:
            texts = [None if x is None else encoding.decode_bytes(x).decode("utf-8", "replace") for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.mapInArrow(run, rows.drop("ids").schema.add("text", "string"))
