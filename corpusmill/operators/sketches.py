"""Fingerprints of texts by MinHash, and the pairs of texts that they bring together.

The fingerprint of a text is a sequence of MinHash symbols of its character
windows, cut into segments. Two texts of similarity J agree in each symbol with
probability J. Every text enters its segments' Hamming balls into one table: a
segment with each of its symbols left out in turn, so that two segments meet in
the table exactly if they differ in one symbol at most. Texts that meet have
their complete fingerprints' distance verified, the number of symbols that
differ in their four bits, and what is left is scored exactly on the windows
themselves.

With 18 segments of 6 symbols two texts of similarity 0.7 miss each other with
probability 6e-5, of 0.75 with 1e-6; the distance that is let through lies 4.5
standard deviations beyond the expected one at 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut

WINDOW, SEGMENTS, SYMBOLS = 5, 18, 6


def most_apart(least: float, symbols: int) -> int:
    """The distance that two fingerprints of similarity ``least`` stay within but for 4.5 standard deviations. Symbols that differ have equal bits once in sixteen times."""
    differ = (1 - least) * 15 / 16
    return int(symbols * differ + 4.5 * (symbols * differ * (1 - differ)) ** 0.5) + 1


def apart(p: str, q: str, symbols: int) -> Column:
    """In how many symbols two fingerprints, arrays of bigints with four bits a symbol, differ."""
    x = [F.get(p, F.lit(i)).bitwiseXOR(F.get(q, F.lit(i))) for i in range(-(-symbols // 16))]
    some = [v.bitwiseOR(F.shiftrightunsigned(v, 1)) for v in x]
    some = [v.bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseAND(F.lit(0x1111111111111111)) for v in some]
    return sum((F.bit_count(v) for v in some[1:]), F.bit_count(some[0]))


def fingerprints(texts: DataFrame, window: int = WINDOW, segments: int = SEGMENTS, symbols: int = SYMBOLS) -> DataFrame:
    """``texts`` (``id`` bigint, ``t`` string) as ``id, keys`` (segments with a symbol left out) ``, bits`` (four bits a symbol) and ``size`` (distinct windows)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n = segments * symbols
        rng = np.random.default_rng(20)
        # 32 bits, which processors multiply and compare in vectors
        times = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        plus = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        place = rng.integers(0, 1 << 63, (segments, symbols), dtype=np.uint64)

        def mix(x):  # noqa: ANN001, ANN202
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

        for batch in batches:
            keys, bits, sizes = [], [], []
            for blob in batch.column(1).to_pylist():
                codes = np.frombuffer(blob.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
                h = np.zeros(max(len(codes) - window + 1, 1), np.uint64)
                for k in range(min(window, len(codes))):
                    h = h * np.uint64(0x100000001B3) + codes[k : k + len(h)] if len(codes) >= window else h * np.uint64(0x100000001B3) + codes[k]
                h = np.unique((mix(h) >> np.uint64(32)).astype(np.uint32))
                sizes.append(len(h))
                least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
                for start in range(0, len(h), 512):  # fits the cache
                    least = np.minimum(least, (times[:, None] * h[None, start : start + 512] + plus[:, None]).min(axis=1))
                symbol = mix(least.astype(np.uint64) + np.uint64(1)).reshape(segments, symbols)
                four = np.zeros(-(-n // 16) * 16, np.uint8)
                four[:n] = (symbol & np.uint64(15)).ravel()
                bits.append((four[::2] * 16 + four[1::2]).view(np.int64))
                g = mix(symbol ^ place)
                keys.append(mix(g.sum(axis=1, keepdims=True, dtype=np.uint64) - g + place).ravel().view(np.int64))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (len(x[0]) if x else 0)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x in (keys, bits)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(sizes, pa.int32())], names=["id", "keys", "bits", "size"])

    return texts.select("id", F.col("t").cast("binary").alias("t")).mapInArrow(run, "id bigint, keys array<bigint>, bits array<bigint>, size int")


def scored(pairs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``pairs`` (``a, b, ta, tb``) as ``a, b, score, containment``: shared distinct windows divided by distinct windows in either, and by those of the text with fewer."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def windows(t: str) -> set[str]:
            return {t[i : i + window] for i in range(max(1, len(t) - window + 1))}

        last, one = None, set()
        for batch in batches:
            scores, inside = [], []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if ta != last:
                    last, one = ta, windows(ta)
                two = windows(tb)
                both = len(one & two)
                scores.append(both / (len(one) + len(two) - both))
                inside.append(both / min(len(one), len(two)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(inside, pa.float64())], names=["a", "b", "score", "containment"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, score double, containment double")


def near_texts(texts: DataFrame, least: float, window: int = WINDOW, segments: int = SEGMENTS, symbols: int = SYMBOLS) -> DataFrame:
    """``a, b, score, containment`` of the pairs of texts at least ``least`` similar, ``a < b``.

    ``texts`` has ``id`` (bigint, unique) and ``t``, no two of them equal, none
    null or empty, and is read three times: it should be written already. Only
    keys, fingerprints and, of pairs that these let through, texts are shuffled.
    """
    prints = cut(fingerprints(texts, window, segments, symbols))
    table = prints.select("id", F.explode("keys").alias("key"))
    met = table.alias("x").join(table.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    side = lambda k, v: prints.select(F.col("id").alias(k), F.col("bits").alias(v), F.col("size").alias(f"n{v}"))
    close = met.join(side("a", "p"), "a").join(side("b", "q"), "b")
    alike = F.least("np", "nq") >= F.floor(F.greatest("np", "nq") * least - 1)  # hashes of windows may coincide
    close = close.where(alike & (apart("p", "q", segments * symbols) <= most_apart(least, segments * symbols))).select("a", "b")
    held = close.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    return scored(held, window).where(F.col("score") >= least)


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``id, rep, n`` of the classes of equal texts of ``rows`` (``id`` bigint, ``t``, none null), and the text ``id, t`` of each class's smallest id, written.

    Texts are compared by 128 bits of hash; only those of the representatives are
    shuffled. An id that is repeated with one text counts once.
    """
    hashed = cut(rows.select("id", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(3), "t", F.lit(5)).alias("g")).distinct())
    groups = hashed.groupBy("h", "g").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    first = rows.join(groups.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    return cut(hashed.join(groups, ["h", "g"]).select("id", "rep", "n")), cut(first)
