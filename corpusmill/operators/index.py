"""An inverted index as tables, and the scores that are read off it."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.sources.tables import cut, shared_folder

K1, B = 1.5, 0.75
RRF_K, RRF_CAP = 60, 300
BOOST = 0.15
FAMILY = 2
# Factors of the layers of a collection.
LAYERS = {"canon": 1.25, "page": 1.0, "raw": 0.72, "index": 0.60, "noise": 0.60}
# Factors by content type, for policies also by how binding they are.
PRIORITY = {"reference": 0.95, "chat": 0.90, "chat_decision": 0.90, "chat_knowledge": 0.90, "chat_todo": 0.90}
POLICY = {"must": 1.10, "should": 1.05, "may": 1.00}
POLICY_DEFAULT = 1.05


#: Folders that a stored index is cut into by the hash of the term.
BUCKETS = 64


@dataclass(frozen=True)
class Index:
    """A stored index: ``postings(term, doc, tf, dl, norm)`` in folders ``bucket``, ``terms(term, df, idf)``, ``docs(doc, dl, norm, sha)`` and the one row ``stats(n, avgdl)``."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def written(df: DataFrame, *by: str, name: str, most: int = 0, codec: str = "snappy") -> DataFrame:
    """``df`` as a table of its own in the shared folder, in folders ``by``, with at most ``most`` rows a file if given."""
    path = f"{shared_folder(df.sparkSession)}/index/{uuid.uuid4().hex}/{name}"
    out = df.write.option("maxRecordsPerFile", most).option("compression", codec)
    (out.partitionBy(*by) if by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def term_counts(texts: DataFrame) -> DataFrame:
    """``doc, term, tf`` of every document of ``doc, t`` with a token; null texts have none."""
    return texts.select("doc", F.explode(X.tokens(F.col("t"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def finished(counts: DataFrame, texts: DataFrame) -> Index:
    """The index of written ``counts`` (``doc, term, tf``) of the documents of ``texts`` (``doc, sha``).

    What is added up across rows for a norm are decimals, so that no order of
    the rows shows in it. Postings carry what every score needs of their
    document, are sorted by term within their bucket, and are spread by bucket,
    term and document, so that a frequent term is no task of its own.
    """
    n = texts.agg(F.count("*").alias("n"))
    terms = written(counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(n).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")), name="terms")
    square = F.pow(F.col("tf") * F.col("idf"), 2)
    weights = counts.join(terms, "term").groupBy("doc").agg(F.sum("tf").alias("dl"), F.sqrt(exact_sum(square)).alias("norm"))
    docs = written(texts.join(weights, "doc", "left").select("doc", F.coalesce("dl", F.lit(0).cast("long")).alias("dl"), F.coalesce("norm", F.lit(1.0)).alias("norm"), "sha"), name="docs")
    stats = written(docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0)).alias("avgdl")), name="stats")
    postings = counts.join(docs.drop("sha"), "doc").select("term", "doc", "tf", "dl", "norm", bucket(F.col("term")).alias("bucket"))
    return Index(written(postings.repartitionByRange("bucket", "term", "doc").sortWithinPartitions("bucket", "term"), "bucket", name="postings"), terms, docs, stats)


def exact_sum(x: Column) -> Column:
    """The sum of doubles as one that doesn't depend on their order."""
    return F.sum(x.cast("decimal(30,15)")).cast("double")


def keyed(texts: DataFrame, doc: str, text: Column) -> DataFrame:
    return texts.select(F.col(doc).alias("doc"), text.alias("t")).withColumn("sha", F.xxhash64("t"))


def build_index(texts: DataFrame, doc: str, text: Column) -> Index:
    """The index of ``texts``, written to the shared folder. Ids have to be unique; documents without tokens count in ``n`` and have norm 1.

    idf is ``ln((n + 1) / (df + 1)) + 1``, the norm the root of the sum of squared
    ``tf * idf``, ``avgdl`` the mean of all lengths. Texts are tokenised once.
    """
    rows = keyed(texts, doc, text)
    return finished(written(term_counts(rows), name="counts"), rows.select("doc", "sha"))


def updated_index(old: Index, texts: DataFrame, doc: str, text: Column) -> Index:
    """The index of ``texts`` made of that of an earlier state: only texts that are new or changed are tokenised.

    The counts of the others are taken from the old postings, those of texts
    that are gone are left out, and frequencies, weights and norms are made
    anew, as they change with the number of texts: the result equals a full build.
    """
    rows = keyed(texts, doc, text)
    same = rows.select("doc", "sha").join(old.docs.select("doc", F.col("sha").alias("was")), "doc").where(F.col("sha").eqNullSafe(F.col("was"))).select("doc")
    kept = old.postings.select("doc", "term", "tf").join(same, "doc", "left_semi")
    fresh = term_counts(rows.join(same, "doc", "left_anti"))
    return finished(written(kept.unionByName(fresh), name="counts"), rows.select("doc", "sha"))


_STORED: dict[tuple, Index] = {}


def stored(spark: SparkSession, key: tuple, build: Callable[[], Index]) -> Index:
    """The index that this application has stored under ``key``, else the one that ``build`` makes; the key has to tell the state of the data."""
    whole = (spark.sparkContext.applicationId, *key)
    if whole not in _STORED:
        _STORED[whole] = build()
    return _STORED[whole]


def query_terms(queries: DataFrame, query: str, text: Column) -> DataFrame:
    """``query, term, qtf``."""
    return queries.select(F.col(query).alias("query"), F.explode(X.tokens(text)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))


def asked_postings(index: Index, q: DataFrame) -> DataFrame:
    """The postings in the folders that the terms of ``q`` lie in."""
    asked = [r.b for r in q.select(bucket(F.col("term")).alias("b")).distinct().collect()]
    return index.postings.where(F.col("bucket").isin(asked)) if len(asked) < BUCKETS else index.postings


def scores(index: Index, q: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """``query, doc, cosine, bm25`` of every query and document that share a term of the index, from one pass over the postings asked for.

    Cosine is that of the tf-idf vectors; terms the index doesn't know are left
    out of the query. BM25 is Okapi's; a repeated query term counts so often.
    """
    rare = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    known = q.join(index.terms, "term").crossJoin(index.stats).select("query", "term", "idf", (F.col("qtf") * F.col("idf")).alias("w"), (rare * F.col("qtf")).alias("r"), "avgdl")
    # the weights of all queries are few next to the postings
    size = known.groupBy("query").agg(F.sqrt(exact_sum(F.col("w") * F.col("w"))).alias("qnorm"))
    known = cut(known.join(size, "query").select("query", "term", (F.col("idf") * F.col("w") / F.col("qnorm")).alias("w"), "r", "avgdl"))
    hit = asked_postings(index, q).join(known, "term")
    part = F.col("r") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1e-9))))
    # whole numbers, whose sum is the same in any order
    whole = lambda x, unit: F.sum(F.round(x * unit).cast("long")) / unit
    return hit.groupBy("query", "doc").agg(whole(F.col("tf") * F.col("w") / F.col("norm"), 1e15).alias("cosine"), whole(part, 1e12).alias("bm25"))


def cosine(index: Index, q: DataFrame) -> DataFrame:
    """``query, doc, score`` by cosine."""
    return scores(index, q).select("query", "doc", F.col("cosine").alias("score"))


def bm25(index: Index, q: DataFrame) -> DataFrame:
    """``query, doc, score`` by BM25."""
    return scores(index, q).select("query", "doc", F.col("bm25").alias("score"))


def candidates(index: Index, passages: DataFrame, query: str, passage: str) -> DataFrame:
    """``query, doc``: documents that may hold the whole passage, as they have the rarest of its tokens that don't touch its ends.

    Passages without such a token have no row; ``has_inner`` tells them.
    """
    terms = passages.select(F.col(query).alias("query"), F.explode(F.array_distinct(X.tokens(inner(F.col(passage))))).alias("term"))
    rarest = terms.join(index.terms.select("term", "df"), "term", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "term")).alias("r")).select("query", "r.term")
    return asked_postings(index, rarest).join(rarest, "term").select("query", "doc")


def inner(text: Column) -> Column:
    """A text without the runs of letters and digits at its ends, which may go on in a text that holds it."""
    return F.regexp_replace(text, "^[A-Za-z0-9]+|[A-Za-z0-9]+$", " ")


def ranked(scores: DataFrame, most: int, digits: int = 9) -> DataFrame:
    """``scores`` with ``rank`` from 1 by score, then doc, for the first ``most`` of each query. Scores equal to ``digits`` decimals are ties."""
    w = Window.partitionBy("query").orderBy(F.round("score", digits).desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rrf(both: DataFrame, k: int = RRF_K, cap: int = RRF_CAP) -> DataFrame:
    """``query, doc, score``: the reciprocal ranks by ``cosine`` and by ``bm25`` of ``both``, of the first ``cap`` of each, added. ``both`` is read twice."""
    places = [ranked(both.select("query", "doc", F.col(c).alias("score")), cap).select("query", "doc", F.lit(c).alias("by"), "rank") for c in ("cosine", "bm25")]
    first = lambda c: F.coalesce(F.max(F.when(F.col("by") == c, 1 / (F.col("rank") + k))), F.lit(0.0))
    return places[0].unionByName(places[1]).groupBy("query", "doc").agg((first("cosine") + first("bm25")).alias("score"))


def field_matches(queries: DataFrame, query: str, text: Column, fields: DataFrame) -> DataFrame:
    """``query, doc, n``: how often a token of the query is a value of one of the document's fields.

    ``fields`` has ``doc, value``, with repeats; repeated query tokens count again.
    """
    q = query_terms(queries, query, text)
    return fields.join(q, fields["value"] == q["term"]).groupBy("query", "doc").agg(F.sum("qtf").alias("n"))


def note_fields(notes: DataFrame, doc: str) -> DataFrame:
    """``doc, value`` of notes: tags whole and as they are, and the tokens of the summary."""
    values = F.concat(F.coalesce(F.array_compact("tags"), F.array().cast("array<string>")), F.coalesce(X.tokens(F.col("kb_summary")), F.array().cast("array<string>")))
    return notes.select(F.col(doc).alias("doc"), F.explode(values).alias("value"))


def boosted(scores: DataFrame, matches: DataFrame, boost: float = BOOST) -> DataFrame:
    """Scores plus ``boost`` for each match; a document that only matches is added."""
    j = scores.join(matches.select("query", "doc", "n"), ["query", "doc"], "full")
    return j.select("query", "doc", (F.coalesce("score", F.lit(0.0)) + F.coalesce(F.col("n") * boost, F.lit(0.0))).alias("score"))


def case_map(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def layer_factor(layer: Column, confidence: Column) -> Column:
    """The factor of a layer; within the canon also of confidence (0.5 where null). 1 for null and unknown layers."""
    low = F.lower(F.trim(layer))
    return case_map(low, LAYERS, 1.0) * F.when(low == "canon", 1 + 0.2 * (F.coalesce(confidence, F.lit(0.5)) - 0.5) * 2).otherwise(F.lit(1.0))


def priority_factor(content_type: Column, enforce: Column) -> Column:
    """The factor of a content type, for policies by how binding they are."""
    return F.when(content_type == "policy", case_map(enforce, POLICY, POLICY_DEFAULT)).otherwise(case_map(content_type, PRIORITY, 1.0))


def family_best(scores: DataFrame, roots: DataFrame, top: int, per_family: int = FAMILY) -> DataFrame:
    """The ``top`` documents of each query, at most ``per_family`` of one root, with their family's number of hits as ``siblings``.

    ``roots`` has ``doc, root``; a document without a row is its own root.
    """
    s = scores.join(roots, "doc", "left").withColumn("root", F.coalesce("root", F.col("doc").cast("string")))
    family = Window.partitionBy("query", "root")
    best = family.orderBy(F.round("score", 9).desc(), "doc")
    s = s.withColumn("siblings", F.count("*").over(family)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= per_family)
    return ranked(s, top).select("query", "doc", "score", "siblings", "rank")


def tail_fill(lexical: DataFrame, dense: DataFrame, k: int, share: float = 0.4) -> DataFrame:
    """``query, doc, score, rank``: the first of the lexical hits, then documents that only the dense list has, up to ``k``.

    ``round((1 - share) * k)`` lexical hits stay, one at least; the filled ones
    get the last kept score times ``1 - 1e-6`` a step. Queries with no more
    lexical hits than stay are left as they are.
    """
    keep = max(1, min(k, int((1 - share) * k + 0.5)))
    lex = ranked(lexical, k)
    n = lex.groupBy("query").agg(F.count("*").alias("have"))
    head = lex.join(n, "query")
    kept = head.where((F.col("rank") <= keep) | (F.col("have") <= keep)).select("query", "doc", "score", "rank")
    floor = head.where((F.col("rank") == keep) & (F.col("have") > keep)).select("query", F.col("score").alias("floor"))
    new = dense.join(kept.select("query", "doc"), ["query", "doc"], "left_anti").join(floor, "query")
    new = ranked(new, k - keep)
    return kept.unionByName(new.select("query", "doc", (F.col("floor") * (1 - 1e-6 * F.col("rank"))).alias("score"), (F.col("rank") + keep).alias("rank")))


#: Bytes of query vectors that the tasks hold at once; more are asked in blocks.
QUERY_BYTES = 64_000_000


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, doc: str = "vec_id", vector: str = "embedding", query: str = "vec_id") -> DataFrame:
    """``query, doc, score, rank``: the ``k`` vectors with the largest positive dot product for each query vector; scores equal to six decimals are ties, by doc.

    A stated set of queries against all vectors: each task multiplies its
    batches with a block of queries of at most ``QUERY_BYTES`` and keeps the best
    ``k`` of each; a block more is a pass more over the vectors. Ids are bigints
    and unique; null vectors take no part; those of another length than the
    first query's are an error.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(doc).cast("long").alias("id"), F.col(vector).alias("v"))
    size = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    blocks = max(1, -(-(size.n * (size.d or 0) * 8) // QUERY_BYTES))
    out = None
    for b in range(blocks):
        rows = q.where(F.expr(f"pmod(xxhash64(id), {blocks}) = {b}")).orderBy("id").collect()
        held = vectors.sparkSession.sparkContext.broadcast(([r.id for r in rows], [r.v for r in rows]))

        def search(batches: Iterator, held=held) -> Iterator:
            import numpy as np
            import pyarrow as pa

            ids, asked = held.value
            matrix = np.array(asked, np.float64)
            best = np.full((len(ids), 0), -np.inf), np.zeros((len(ids), 0), np.int64)
            for batch in batches:
                if not len(batch) or not ids:
                    continue
                docs, lists = batch.column(0).to_numpy(), batch.column(1)
                table = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                dots = np.concatenate([best[0], np.round(matrix @ table.T, 9)], axis=1)
                names = np.concatenate([best[1], np.broadcast_to(docs, (len(ids), len(docs)))], axis=1)
                keep = np.lexsort((names, -np.round(dots, 6)), axis=1)[:, :k]
                best = np.take_along_axis(dots, keep, 1), np.take_along_axis(names, keep, 1)
            good = best[0] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), good.sum(1))), pa.array(best[1][good]), pa.array(best[0][good])], names=["query", "doc", "score"])

        part = v.mapInArrow(search, "query bigint, doc bigint, score double")
        out = part if out is None else out.unionByName(part)
    return ranked(out, k, 6)


def rerank_score(overlap: Column, domain: Column, tags: Column, ctype: Column, importance: Column, enforce: Column, age: Column) -> Column:
    """The heuristic second score of a hit: token overlap, matching fields, importance, how binding it is, and how new."""
    front = F.least(F.lit(1.0), 0.4 * domain.cast("double") + 0.3 * tags.cast("double") + 0.3 * ctype.cast("double"))
    binding = case_map(enforce, {"must": 1.0, "should": 0.7, "may": 0.4}, 0.5)
    recent = F.when(age.isNull(), 0.5).when(age <= 30, 1 - age / 60).otherwise(0.3)
    return 0.4 * overlap + 0.2 * front + 0.2 * F.coalesce(importance, F.lit(0.5)) + 0.1 * binding + 0.1 * recent
