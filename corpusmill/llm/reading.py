"""Reading level of each document by familiar words and sentence length.

The high-frequency list holds the words that stand in at least a share of the
corpus's documents, counted over all of it. A bounded sample of rated documents
grades it: a listed word is at home at the level whose sentences use it clearly
more often than the others do, and familiar at every level if none does. So
there are two nested lists, words familiar to readers of easy text and to
readers of ordinary text.

The formula of a paragraph has the share of its words outside the easy list,
the share outside the ordinary list, and the logarithm of its mean sentence
length in words; a word that is in no list is outside both. It gives each level
a score; the weights are fitted to the ratings, for Han script and for others
apart as their words are of different size. The level of a document is the one
at which most of its text stands, by the characters of its paragraphs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut

#: Share of the documents that a word of the high-frequency list stands in, at least.
SHARE = 0.002
#: Rated documents that the formula is fitted on, at most, and the longest of them in characters.
RATED, RATED_CHARS = 4000, 20_000

_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?|[㐀-䶿一-鿿]+|[^\W\d_a-z㐀-䶿一-鿿]+")
_CODE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_BLANK = re.compile(r"\n\s*\n")
_HAN = re.compile(r"[㐀-䶿一-鿿]+")
_SENTENCE = re.compile(r"(?<=[。！？!?…])|(?<=\.)\s|\n")


def words(text: str) -> list[str]:
    """Words of a text in lower case: runs of letters, and of Han characters each pair of neighbours."""
    out: list[str] = []
    for w in _WORD.findall(text):
        if "㐀" <= w[0] <= "鿿" and len(w) > 1:
            out += map("".join, zip(w, w[1:]))
        else:
            out.append(w)
    return out


def paragraphs(text: str) -> list[list[str]]:
    """Paragraphs as their sentences, in lower case, outside code, tables and headings; all lines where nothing else is there."""
    lower = text.lower()
    told = lambda s: s and not s.isspace()
    out = [[s for s in _SENTENCE.split(p) if told(s) and s.lstrip()[0] not in "|#"] for p in _BLANK.split(_CODE.sub("\n\n", lower))]
    out = [p for p in out if p]
    return out or [[s for s in lower.split("\n") if told(s)]]


def is_han(sentences: list[str]) -> bool:
    """Whether a fifth or more of the characters are Han."""
    return sum(len(x) for s in sentences for x in _HAN.findall(s)) * 5 >= sum(map(len, sentences))


def document_frequencies(documents: DataFrame, text: str = "text") -> DataFrame:
    """``word, docs`` over all documents, with the number of texts that aren't blank as the word ''. Counted within tasks first."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "docs"])

        seen: Counter = Counter()
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                t = blob.decode("utf-8", "replace").lower()
                if t and not t.isspace():
                    seen[""] += 1
                    seen.update(set(words(t)))
            if len(seen) > 500_000:
                yield out()
                seen.clear()
        yield out()

    rows = documents.select(F.col(text).cast("binary").alias("t")).where("t is not null")
    return rows.mapInArrow(count, "word string, docs bigint").groupBy("word").agg(F.sum("docs").alias("docs"))


class Formula:
    """The graded list, and the weights of the formula for each script."""

    def __init__(self, home: dict[str, int], weights: dict[bool, list[list[float]]], usual: int):
        # 0: familiar everywhere, 1 to 3: at home there, absent: in no list
        self.home, self.weights, self.usual = home, weights, usual

    @staticmethod
    def terms(home: dict[str, int], paragraph: list[str]) -> tuple[float, float, float, float] | None:
        """1, the shares of words outside the easy and the ordinary list, and the logarithm of the mean sentence length; null without a word."""
        get, n, hard, ordinary = home.get, 0, 0, 0
        for s in paragraph:
            for w in words(s):
                h = get(w, 3)
                n += 1
                hard += h == 3
                ordinary += h == 2
        return (1.0, (ordinary + hard) / n, hard / n, math.log(n / len(paragraph))) if n else None

    def paragraph(self, paragraph: list[str]) -> int | None:
        """The level with the highest score, the lower of equals."""
        x = self.terms(self.home, paragraph)
        weights = self.weights.get(is_han(paragraph)) if x else None
        if weights is None:
            return None
        scores = [sum(a * b for a, b in zip(w, x)) for w in weights]
        return scores.index(max(scores)) + 1

    def level(self, text: str) -> int:
        """1, 2 or 3: where most of the text stands; the lower of equals, and the usual level of rated texts where nothing tells."""
        size = [0, 0, 0]
        for p in paragraphs(text):
            y = self.paragraph(p)
            if y is not None:
                size[y - 1] += sum(map(len, p))
        return size.index(max(size)) + 1 if any(size) else self.usual

    @staticmethod
    def grades(listed: set[str], rated: list[tuple[int, list[str]]], rounds: int = 3) -> dict[str, int]:
        """Levels of the words of ``listed`` that stand in rated sentences. A sentence may be of another level than its text's rating; that is estimated in turn with the words' levels."""
        import numpy as np

        flat = [(level, list(dict.fromkeys(w for w in words(s) if w in listed))) for level, ss in rated for s in ss]
        flat = [x for x in flat if x[1]]
        home = dict.fromkeys(listed, 0)
        if not flat:
            return home
        of = np.array([level - 1 for level, _ in flat])
        at = np.eye(3)[of]
        vocab = {w: i for i, w in enumerate(sorted({w for _, ws in flat for w in ws}))}
        row = np.repeat(np.arange(len(flat)), [len(ws) for _, ws in flat])
        col = np.array([vocab[w] for _, ws in flat for w in ws])
        prior = np.log(np.where(np.eye(3)[of] > 0, 0.7, 0.15))
        for _ in range(rounds):
            counts = np.zeros((len(vocab), 3))
            np.add.at(counts, col, at[row])
            rate = (counts + 0.3) / (at.sum(0) + 3)
            share = rate / rate.sum(1, keepdims=True)
            score = prior.copy()
            np.add.at(score, row, np.log(share)[col])
            at = np.exp(score - score.max(1, keepdims=True))
            at /= at.sum(1, keepdims=True)
        home.update((w, int(share[i].argmax()) + 1) for w, i in vocab.items() if share[i].max() >= 0.6)
        return home

    @classmethod
    def fit(cls, listed: set[str], rated: list[tuple[str, int]], rounds: int = 3) -> "Formula":
        """From the list and ``(text, level)`` pairs, by multinomial logistic regression; paragraphs may be of another level than their text's rating, which is estimated in turn with the weights."""
        import numpy as np

        texts = [(level, paragraphs(t)) for t, level in rated]
        usual = min(Counter(level for level, _ in texts).items(), key=lambda x: (-x[1], x[0]))[0] if texts else 2
        home = cls.grades(listed, [(level, [s for p in ps for s in p]) for level, ps in texts])
        weights: dict[bool, list[list[float]]] = {}
        for script in (False, True):
            rows = [(x, level) for level, ps in texts for p in ps if is_han(p) == script and (x := cls.terms(home, p)) is not None]
            if not rows:
                continue
            x, rating = np.array([r[0] for r in rows]), np.eye(3)[[r[1] - 1 for r in rows]]
            prior, at = np.log(np.where(rating > 0, 0.8, 0.1)), rating
            for _ in range(rounds):
                w = np.zeros((x.shape[1], 3))
                for _ in range(60):  # Newton's steps with one curvature for the three levels
                    p = np.exp(x @ w - (x @ w).max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    bend = (x * (p * (1 - p)).mean(1)[:, None]).T @ x / len(x) + 1e-3 * np.eye(x.shape[1])
                    w -= 0.7 * np.linalg.solve(bend, x.T @ (p - at) / len(x) + 1e-3 * w)
                score = x @ w + prior
                at = np.exp(score - score.max(1, keepdims=True))
                at /= at.sum(1, keepdims=True)
            weights[script] = w.T.tolist()
        for script in (False, True):  # a script without a rated paragraph goes by the other's weights
            if weights and script not in weights:
                weights[script] = weights[not script]
        return cls(home, weights, usual)


def reading_levels(documents: DataFrame, ratings: DataFrame, doc_id: str = "doc_id", text: str = "text", rating: str = "reading_level", share: float = SHARE, rated: int = RATED, rated_chars: int = RATED_CHARS) -> DataFrame:
    """``doc_id, reading_level`` (bigint: 1 easy, 2 ordinary, 3 demanding) of every document whose text isn't blank.

    ``ratings`` has ``doc_id`` and a rating from 1 to 3, several a document and
    nulls allowed; a document whose ratings are tied isn't used. The formula is
    fitted on at most ``rated`` documents of at most ``rated_chars`` characters,
    taken by the hash of their ids; every count and every level covers all
    documents, whole. Null and blank texts have no row; repeated rows have one
    each. Without any rating every level is 2. Empty tables give no rows.

    The list that is sent to the tasks has at most the distinct words of a mean
    document divided by ``share``, whatever the size of the corpus.
    """
    votes = ratings.where(F.col(rating).between(1, 3)).groupBy(F.col(doc_id).alias("_d"), F.col(rating).cast("int").alias("level")).agg(F.count("*").alias("n"))
    votes = votes.groupBy("_d").agg(F.max(F.struct("n", "level")).alias("best"), F.collect_list("n").alias("all")).where("size(filter(all, x -> x = best.n)) = 1").select("_d", F.col("best.level").alias("level"))
    # where there are more rated documents than the sample holds, the hash of the id draws nine tenths of a sample before texts are read
    drawn = 0.9 * rated / max(votes.count(), 1)
    if drawn < 1:
        votes = votes.where(F.pmod(F.xxhash64("_d"), F.lit(1_000_000_007)) < int(drawn * 1_000_000_007))
    sample = documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.char_length("t") <= rated_chars)).join(votes, "_d")
    chosen = [(r.t, r.level) for r in sample.orderBy(F.xxhash64("_d"), "_d", "t").limit(rated).select("t", "level").collect()]
    counts = document_frequencies(documents, text)
    # a word of the list stands in three documents at least; those counts are kept, not made again for the total
    counts = cut(counts.where("docs >= 3 or word = ''"))
    total = counts.where("word = ''").agg(F.sum("docs")).first()[0] or 0
    listed = {r.word for r in counts.where((F.col("docs") >= max(3.0, total * share)) & (F.col("word") != "")).select("word").toLocalIterator()}
    formula = Formula.fit(listed, chosen)

    def level(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, levels = [], []
            for i, blob in enumerate(batch.column(1).to_pylist()):
                t = blob.decode("utf-8", "replace")
                if t and not t.isspace():
                    ids.append(i)
                    levels.append(formula.level(t))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int64())), pa.array(levels, pa.int64())], names=["doc_id", "reading_level"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t")).where("t is not null")
    out = rows.mapInArrow(level, rows.drop("t").withColumn("reading_level", F.lit(0).cast("long")).schema)
    return out if doc_id == "doc_id" else out.withColumnRenamed("doc_id", doc_id)
