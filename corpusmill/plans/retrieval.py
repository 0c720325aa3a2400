"""Retrieval: an index over the notes, and the canonical terms as queries against all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import bags as B
from corpusmill.operators import index as I
from corpusmill.plans import sqltext as S
from corpusmill.sources.tables import cut, shared_out, state_of, table

AS_OF = "2026-01-01"


def note_text() -> Column:
    return F.concat_ws(" ", "title", "body", F.array_join(F.array_compact("tags"), " "))


def notes_index(spark: SparkSession, folder: str) -> I.Index:
    """The index of all notes, built once an application and state of the table."""
    return I.stored(spark, ("notes", *state_of(spark, folder, "note_record")), lambda: I.build_index(table(spark, folder, "note_record"), "note_id", note_text()))


def note_words(spark: SparkSession, folder: str) -> B.Words:
    """The words of all notes, counted once an application and state of the table."""
    return I.stored(spark, ("note words", *state_of(spark, folder, "note_record")), lambda: B.words(B.bags(shared_out(spark, folder, "note_record", "note_id"), "note_id", note_text())))


def term_queries(spark: SparkSession, folder: str) -> DataFrame:
    return I.query_terms(table(spark, folder, "canon_term"), "term_id", F.col("term"))


def tf_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Term counts of every note."""
    return notes_index(spark, folder).postings.select("doc", "term", "tf")


def df_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and weight of every term."""
    return notes_index(spark, folder).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def doc_norms(spark: SparkSession, folder: str) -> DataFrame:
    """Length and norm of every note."""
    return notes_index(spark, folder).docs.select("doc", "dl", F.round("norm", 6).alias("norm"))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Number of notes and their mean length."""
    return notes_index(spark, folder).stats.select("n", F.round("avgdl", 4).alias("avgdl"))


def _six(score: str) -> Column:
    """A score with six decimals; a half that doubles miss by their last bit is a half."""
    return F.round(F.round(score, 12), 6).alias(score)


def _top(scores: DataFrame, k: int = 10) -> DataFrame:
    return I.ranked(scores, k).select("query", "doc", _six("score"), F.col("rank").cast("long").alias("rank"))


def cosine_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten notes nearest to each term by tf-idf cosine."""
    return _top(I.cosine(notes_index(spark, folder), term_queries(spark, folder)))


def bm25_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best notes for each term by BM25."""
    return _top(I.bm25(notes_index(spark, folder), term_queries(spark, folder)))


def index_update(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the notes recorded up to the end of 2025, brought to that of all notes, with each note's length and norm and how many terms and postings there are."""
    notes = table(spark, folder, "note_record")
    old = I.build_index(notes.where("recorded_at < timestamp_ntz'2026-01-01 00:00:00'"), "note_id", F.concat_ws(" ", "title", "body"))
    new = I.updated_index(old, notes, "note_id", note_text())
    counts = new.terms.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return new.docs.crossJoin(counts).select("doc", "dl", F.round("norm", 6).alias("norm"), "terms", "postings")


def _fused(index: I.Index, q: DataFrame) -> DataFrame:
    return I.rrf(cut(I.scores(index, q)))


def rrf_top10(spark: SparkSession, folder: str) -> DataFrame:
    """Both rankings fused."""
    return _top(_fused(notes_index(spark, folder), term_queries(spark, folder)))


def field_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How often each term's tokens are tags or summary tokens of a note."""
    return I.field_matches(table(spark, folder, "canon_term"), "term_id", F.col("term"), I.note_fields(table(spark, folder, "note_record"), "note_id"))


def _boosted(spark: SparkSession, folder: str) -> DataFrame:
    return I.boosted(_fused(notes_index(spark, folder), term_queries(spark, folder)), field_matches(spark, folder))


def boosted_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The fused ranking with field matches added."""
    return _top(_boosted(spark, folder))


def hybrid_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranking: fusion, field boost, filters, layer and priority factors, at most two hits a source path, ten a query.

    Filters: status active, stable, legacy or none; importance at least 0.1.
    """
    notes = table(spark, folder, "note_record")
    status = F.lower(F.trim("status"))
    kept = notes.where((F.coalesce(status, F.lit("")).isin("active", "stable", "legacy", "")) & (F.coalesce("importance", F.lit(0.0)) >= 0.1))
    factors = kept.select(F.col("note_id").alias("doc"), (I.layer_factor(F.col("kb_layer"), F.lit(None).cast("double")) * I.priority_factor(F.col("content_type"), F.lit(None).cast("string"))).alias("factor"), F.lower("rel").alias("root"))
    scored = _boosted(spark, folder).join(factors, "doc").select("query", "doc", (F.col("score") * F.col("factor")).alias("score"), "root")
    best = I.family_best(scored.drop("root"), factors.select("doc", "root"), 10)
    return best.select("query", "doc", _six("score"), F.col("siblings").cast("long").alias("siblings"), F.col("rank").cast("long").alias("rank"))


def chunk_family_top(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks for each term, at most two of one parent."""
    chunks = table(spark, folder, "chunk_note").dropDuplicates(["chunk_id"])
    index = I.stored(spark, ("chunks", *state_of(spark, folder, "chunk_note")), lambda: I.build_index(chunks, "chunk_id", F.col("body")))
    roots = chunks.select(F.col("chunk_id").alias("doc"), F.coalesce("chunk_of", "filename").alias("root"))
    best = I.family_best(I.bm25(index, term_queries(spark, folder)), roots, 10)
    return best.select("query", "doc", F.round("score", 6).alias("score"), F.col("siblings").cast("long").alias("siblings"), F.col("rank").cast("long").alias("rank"))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, folder, "embeddings")
    return v, v.where("vec_id % 100 = 0")


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors with the largest dot product for every hundredth vector, against all."""
    return I.dense_top(*_vectors(spark, folder), 10).select("query", "doc", F.round("score", 4).alias("score"))


def dense_tail_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Lexical top ten of notes with the places from the seventh filled from a second ranking (titles only)."""
    notes = table(spark, folder, "note_record")
    q = term_queries(spark, folder)
    lexical = I.bm25(notes_index(spark, folder), q)
    titles = I.cosine(I.stored(spark, ("titles", *state_of(spark, folder, "note_record")), lambda: I.build_index(notes, "note_id", F.col("title"))), q)
    return I.tail_fill(lexical, titles, 10).select("query", "doc", F.col("rank").cast("long").alias("rank"))


def adjusted_top10(spark: SparkSession, folder: str) -> DataFrame:
    """Fused ranking with a contract: a term whose key equals an alias's key puts a note that carries the alias's tag up by 0.9."""
    fused = _fused(notes_index(spark, folder), term_queries(spark, folder))
    terms = table(spark, folder, "canon_term")
    contract = terms.select("term_id", F.col("term").alias("tag")).distinct()
    tagged = table(spark, folder, "note_record").select(F.col("note_id").alias("doc"), F.explode(F.array_distinct(F.array_compact("tags"))).alias("tag"))
    hits = tagged.join(contract, "tag").select(F.col("term_id").alias("query"), "doc", F.lit(0.9).alias("score"))
    known = hits.join(fused.select("query", "doc"), ["query", "doc"], "left_semi")
    return _top(fused.unionByName(known).groupBy("query", "doc").agg(F.sum("score").alias("score")))


def title_boosted_top10(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine, the first 200 of a query raised by the share of its longer tokens that stand in the note's title, summary, tags or path."""
    first = I.ranked(I.cosine(notes_index(spark, folder), term_queries(spark, folder)), 200).select("query", "doc", "score")
    q = table(spark, folder, "canon_term").select(F.col("term_id").alias("query"), F.filter(F.array_distinct(X.tokens(F.col("term"))), lambda t: F.char_length(t) > 1).alias("q"))
    titles = table(spark, folder, "note_record").select(F.col("note_id").alias("doc"), F.lower(F.concat_ws(" ", F.coalesce("title", X.path_stem(F.col("rel"))), F.substring("kb_summary", 1, 120), F.array_join(F.array_compact("tags"), " "), "rel")).alias("t"))
    s = first.join(q, "query").join(titles, "doc")
    cover = F.size(F.filter("q", lambda t: F.contains(F.col("t"), t))) / F.greatest(F.size("q"), F.lit(1))
    return _top(s.select("query", "doc", (F.col("score") * (1 + 0.55 * cover)).alias("score")))


def reranked_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty by BM25 scored again by token overlap, domain, tags and content type that stand in the term, importance and age on a fixed day, the ten best kept."""
    first = I.ranked(I.bm25(notes_index(spark, folder), term_queries(spark, folder)), 20).select("query", "doc")
    q = table(spark, folder, "canon_term").select(F.col("term_id").alias("query"), "term", F.array_distinct(X.tokens(F.col("term"))).alias("q"))
    n = table(spark, folder, "note_record").select(F.col("note_id").alias("doc"), F.array_distinct(X.tokens(note_text())).alias("d"), "domain", F.array_compact("tags").alias("tags"), "content_type", "importance", F.datediff(F.lit(AS_OF).cast("date"), F.coalesce("updated", "created")).alias("age"))
    s = first.join(q, "query").join(n, "doc")
    overlap = F.size(F.array_intersect("q", "d")) / F.greatest(F.size(F.array_union("q", "d")), F.lit(1))
    stands = lambda text, part: F.coalesce((part != "") & F.contains(text, part), F.lit(False))
    tagged = F.coalesce(F.exists("tags", lambda t: stands(F.col("term"), t)), F.lit(False))
    score = I.rerank_score(overlap, stands(F.col("term"), F.col("domain")), tagged, stands(F.lower("term"), F.col("content_type")), F.col("importance"), F.lit(None).cast("string"), F.col("age"))
    return _top(s.select("query", "doc", score.alias("score")))


def expanded_top10(spark: SparkSession, folder: str) -> DataFrame:
    """BM25 with each term's aliases as synonyms of its text."""
    q = I.query_terms(table(spark, folder, "canon_term"), "term_id", F.concat_ws(" ", "term", F.array_join("aliases", " ")))
    return _top(I.bm25(notes_index(spark, folder), q))


def answers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``query, doc`` of the documents that hold a held-out question's passage, and ``query, doc, rank`` of the ten best for each question."""
    docs = table(spark, folder, "documents").where("text is not null")
    items = table(spark, folder, "eval_item").where("item_id is not null and passage is not null").select("item_id", "question", "passage")
    index = I.stored(spark, ("documents", *state_of(spark, folder, "documents")), lambda: I.build_index(docs, "doc_id", F.col("text")))
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    asked = items.select(F.col("item_id").alias("query"), "passage")
    # a document holds a passage only if it has the passage's rarest inner token
    met = I.candidates(index, items, "item_id", "passage").join(asked, "query").join(texts, "doc")
    plain = asked.where(F.size(X.tokens(I.inner(F.col("passage")))) == 0).crossJoin(texts)
    gold = met.select("query", "doc", "passage", "text").unionByName(plain.select("query", "doc", "passage", "text")).where(F.contains("text", "passage")).select("query", "doc").distinct()
    hits = I.ranked(I.bm25(index, I.query_terms(items, "item_id", F.col("question"))), 10).select("query", "doc", "rank")
    return gold, hits


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """First hit, recall among one, four, five and ten, and mean reciprocal rank of the held-out questions over the documents that hold their passage."""
    gold, hits = answers(spark, folder)
    among = lambda k: F.count(F.when(F.col("rank") <= k, 1)).alias(f"k{k}")
    per = gold.join(hits, ["query", "doc"], "left").groupBy("query").agg(F.min("rank").alias("first"), *(among(k) for k in (1, 4, 5, 10)), F.count("*").alias("of"))
    return per.agg(
        F.count("*").alias("questions"), F.round(F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0)), 6).alias("top1"), *(F.round(F.avg(F.col(f"k{k}") / F.col("of")), 6).alias(f"recall_at_{k}") for k in (1, 4, 5, 10)),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def snippet_window(spark: SparkSession, folder: str) -> DataFrame:
    """The best run of at most three sentences of the first five notes of each term: overlap with the term and a usual length.

    A sentence scores its tokens that are the term's, and 0.3 for 30 to 120
    characters, 0.1 for more; a run of n sentences of together at most 320
    characters scores their sum times ``1 + 0.15 (n - 1)``. Ties: the earliest, then the shortest.
    """
    first = I.ranked(I.bm25(notes_index(spark, folder), term_queries(spark, folder)), 5).select("query", "doc")
    q = table(spark, folder, "canon_term").select(F.col("term_id").alias("query"), F.array_distinct(X.tokens(F.col("term"))).alias("q"))
    n = table(spark, folder, "note_record").where("body is not null").select(F.col("note_id").alias("doc"), X.sentences(F.col("body")).alias("s"))
    rows = first.join(q, "query").join(n, "doc").select("query", "doc", "q", F.posexplode("s").alias("i", "t"))
    length = F.char_length("t")
    score = F.size(F.filter(X.tokens(F.col("t")), lambda x: F.array_contains("q", x))) + F.when(length > 120, 0.1).when(length >= 30, 0.3).otherwise(0.0)
    rows = rows.select("query", "doc", "i", length.alias("len"), score.alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("query", "doc").orderBy("i")
    runs = [rows.select("query", "doc", "i", F.lit(k).alias("k"), F.sum("len").over(w.rowsBetween(0, k - 1)).alias("len"), F.count("*").over(w.rowsBetween(0, k - 1)).alias("n"), (F.sum("score").over(w.rowsBetween(0, k - 1)) * (1 + 0.15 * (k - 1))).alias("score")) for k in (1, 2, 3)]
    every = runs[0].unionByName(runs[1]).unionByName(runs[2]).where("n = k and (len <= 320 or k = 1)")
    best = Window.partitionBy("query", "doc").orderBy(F.round("score", 9).desc(), "i", "k")
    out = every.withColumn("r", F.row_number().over(best)).where("r = 1")
    return out.select("query", "doc", F.col("i").cast("long").alias("sentence"), F.col("k").cast("long").alias("n_sentences"), F.round("score", 6).alias("score"))


def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best notes of each term as far as a budget of 1500 tokens goes; the last one cut where more than 50 are left."""
    from pyspark.sql import Window

    first = I.ranked(I.bm25(notes_index(spark, folder), term_queries(spark, folder)), 10).select("query", "doc", "rank")
    n = table(spark, folder, "note_record").select(F.col("note_id").alias("doc"), X.token_count(F.col("body")).alias("t"))
    w = Window.partitionBy("query").orderBy("rank")
    s = first.join(n, "doc").withColumn("before", F.coalesce(F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = F.least("t", 1500 - F.col("before"))
    return s.where((F.col("before") + F.col("t") <= 1500) | ((1500 - F.col("before") > 50) & (F.col("before") < 1500))).select("query", "doc", F.col("rank").cast("long").alias("rank"), used.alias("tokens"))


QUERIES = {f.__name__: f for f in (
    tf_terms, df_idf, doc_norms, corpus_stats, index_update, cosine_top10, bm25_top10, rrf_top10, field_matches, boosted_top10, hybrid_retrieve, chunk_family_top, dense_topk, dense_tail_fill, adjusted_top10,
    title_boosted_top10, reranked_top10, expanded_top10, retrieval_metrics, snippet_window, context_budget)}

_I, _Q = "WITH " + S.indexed(), ",\n" + S.asked()
_OUT = "SELECT query, doc, round(score, 6) AS score, rank FROM "
_FACTORS = f"factors AS (SELECT note_id AS doc, {S.LAYER} * {S.PRIORITY} AS factor, lower(rel) AS root FROM note_record WHERE coalesce(lower(trim(status)), '') IN ('active', 'stable', 'legacy', '') AND coalesce(importance, 0) >= 0.1)"
_FAMILY = "SELECT query, doc, round(score, 6) AS score, siblings, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY query, root) AS siblings, row_number() OVER (PARTITION BY query, root ORDER BY round(score, 9) DESC, doc) AS place FROM weighted) WHERE place <= 2 QUALIFY rank <= 10"
_CHUNKS = "WITH chunks AS (SELECT * FROM chunk_note QUALIFY row_number() OVER (PARTITION BY chunk_id) = 1), " + S.indexed("chunks", "chunk_id", "body") + _Q
_SENT = "list_filter(list_transform(string_split_regex(body, '[。！？\n]'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"

SQL = {
    "tf_terms": _I + " SELECT doc, term, tf FROM postings",
    "df_idf": _I + " SELECT term, df, round(idf, 6) AS idf FROM terms",
    "doc_norms": _I + " SELECT doc, dl, round(norm, 6) AS norm FROM docs",
    "corpus_stats": _I + " SELECT n, round(avgdl, 4) AS avgdl FROM stats",
    "index_update": _I + " SELECT doc, dl, round(norm, 6) AS norm, (SELECT count(*) FROM terms) AS terms, (SELECT CAST(sum(df) AS BIGINT) FROM terms) AS postings FROM docs",
    "cosine_top10": _I + _Q + " " + _OUT + S.top("cosine", 10),
    "bm25_top10": _I + _Q + " " + _OUT + S.top("bm25", 10),
    "rrf_top10": _I + _Q + ",\n" + S.RRF + " " + _OUT + S.top("fused", 10),
    "field_matches": _I + _Q + ",\n" + S.RRF + ",\n" + S.FIELDS + " SELECT query, doc, n FROM matches",
    "boosted_top10": _I + _Q + ",\n" + S.RRF + ",\n" + S.FIELDS + " " + _OUT + S.top("boosted", 10),
    "hybrid_retrieve": _I + _Q + ",\n" + S.RRF + ",\n" + S.FIELDS + ",\n" + _FACTORS + ", weighted AS (SELECT query, doc, score * factor AS score, root FROM boosted JOIN factors USING (doc)) " + _FAMILY,
    "chunk_family_top": _CHUNKS + ", weighted AS (SELECT query, b.doc, score, coalesce(chunk_of, filename) AS root FROM bm25 b JOIN chunks ON chunk_id = b.doc) " + _FAMILY,
    "dense_topk": "SELECT query, doc, round(score, 4) AS score FROM (SELECT q.vec_id AS query, v.vec_id AS doc, list_dot_product(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, doc) <= 10",
    "dense_tail_fill": _I + _Q + ",\n" + S.indexed("note_record", "note_id", "title").replace("texts", "ttexts").replace("toks", "ttoks").replace("postings", "tpost").replace("nn ", "tnn ").replace(", nn", ", tnn").replace("FROM nn", "FROM tnn").replace("terms", "tterms").replace("weights", "tweights").replace("docs", "tdocs").replace("stats", "tstats")
    + """,
tqw AS (SELECT query, term, idf, qtf * idf AS w FROM q JOIN tterms USING (term)),
tqn AS (SELECT query, sqrt(sum(w * w)) AS qnorm FROM tqw GROUP BY query),
titles AS (SELECT query, doc, dot / qnorm / norm AS score FROM (SELECT query, doc, sum(tf * idf * w) AS dot FROM tpost JOIN tqw USING (term) GROUP BY query, doc) JOIN tqn USING (query) JOIN tdocs USING (doc)),
lex AS """ + S.top("bm25", 10) + """,
have AS (SELECT query, count(*) AS have FROM lex GROUP BY query),
kept AS (SELECT query, doc, rank FROM lex JOIN have USING (query) WHERE rank <= 6 OR have <= 6),
added AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS r FROM titles t JOIN have USING (query) WHERE have > 6 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.query = t.query AND k.doc = t.doc) QUALIFY r <= 4)
SELECT query, doc, rank FROM kept UNION ALL SELECT query, doc, r + 6 FROM added""",
    "adjusted_top10": _I + _Q + ",\n" + S.RRF + f", tagged AS (SELECT DISTINCT note_id AS doc, unnest({S.tags()}) AS tag FROM note_record), hits AS (SELECT term_id AS query, doc, 0.9 AS score FROM tagged JOIN (SELECT DISTINCT term_id, term FROM canon_term) ON term = tag), adjusted AS (SELECT query, doc, sum(score) AS score FROM (SELECT * FROM fused UNION ALL SELECT h.* FROM hits h SEMI JOIN fused USING (query, doc)) GROUP BY query, doc) " + _OUT + S.top("adjusted", 10),
    "title_boosted_top10": _I + _Q + f""", first AS {S.top('cosine', 200)},
qq AS (SELECT term_id AS query, list_filter(list_distinct({S.tokens('term')}), lambda t: length(t) > 1) AS q FROM canon_term),
tt AS (SELECT note_id AS doc, lower(concat_ws(' ', coalesce(title, regexp_replace(regexp_replace(replace(rel, '\\', '/'), '^.*/', '', 's'), '\\.[A-Za-z0-9]{{1,5}}$', '')), substring(kb_summary, 1, 120), array_to_string({S.tags()}, ' '), rel)) AS t FROM note_record),
raised AS (SELECT query, doc, score * (1 + 0.55 * len(list_filter(q, lambda x: contains(t, x))) / greatest(len(q), 1)) AS score FROM first JOIN qq USING (query) JOIN tt USING (doc)) """ + _OUT + S.top("raised", 10),
    "reranked_top10": _I + _Q + f""", first AS {S.top('bm25', 20)},
qq AS (SELECT term_id AS query, term, list_distinct({S.tokens('term')}) AS q FROM canon_term),
dd AS (SELECT note_id AS doc, list_distinct({S.tokens(S.NOTE_TEXT)}) AS d, domain, {S.tags()} AS tags, content_type, importance, date_diff('day', coalesce(updated, created), DATE '{AS_OF}') AS age FROM note_record),
again AS (SELECT query, doc, 0.4 * len(list_intersect(q, d)) / greatest(len(list_distinct(list_concat(q, d))), 1) + 0.2 * (0.4 * coalesce(domain <> '' AND contains(term, domain), false)::INT + 0.3 * coalesce(len(list_filter(tags, lambda t: t <> '' AND contains(term, t))) > 0, false)::INT + 0.3 * coalesce(content_type <> '' AND contains(lower(term), content_type), false)::INT) + 0.2 * coalesce(importance, 0.5) + 0.1 * 0.5 + 0.1 * CASE WHEN age IS NULL THEN 0.5 WHEN age <= 30 THEN 1 - age / 60 ELSE 0.3 END AS score FROM first JOIN qq USING (query) JOIN dd USING (doc)) """ + _OUT + S.top("again", 10),
    "expanded_top10": _I + ",\n" + S.asked(text="concat_ws(' ', term, array_to_string(aliases, ' '))") + " " + _OUT + S.top("bm25", 10),
    "retrieval_metrics": "WITH " + S.indexed("(SELECT * FROM documents WHERE text IS NOT NULL)", "doc_id", "text") + ",\n" + S.asked("eval_item", "item_id", "question") + f""",
gold AS (SELECT DISTINCT item_id AS query, doc_id AS doc FROM documents, eval_item WHERE contains(text, passage)),
per AS (SELECT g.query, min(rank) AS first, {', '.join(f'count(*) FILTER (rank <= {k}) AS k{k}' for k in (1, 4, 5, 10))}, count(*) AS n FROM gold g LEFT JOIN {S.top('bm25', 10)} h ON g.query = h.query AND g.doc = h.doc GROUP BY g.query)
SELECT count(*) AS questions, round(avg(CASE WHEN first = 1 THEN 1.0 ELSE 0 END), 6) AS top1, """ + ", ".join(f"round(avg(k{k} / n), 6) AS recall_at_{k}" for k in (1, 4, 5, 10)) + """, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM per""",
    "snippet_window": _I + _Q + f""", first AS {S.top('bm25', 5)},
qq AS (SELECT term_id AS query, list_distinct({S.tokens('term')}) AS q FROM canon_term),
ss AS (SELECT note_id AS doc, {_SENT} AS s FROM note_record WHERE body IS NOT NULL),
rows AS (SELECT query, doc, q, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS i FROM first JOIN qq USING (query) JOIN ss USING (doc)),
sc AS (SELECT query, doc, i, length(t) AS len, len(list_filter({S.tokens('t')}, lambda x: list_contains(q, x))) + CASE WHEN length(t) > 120 THEN 0.1e0 WHEN length(t) >= 30 THEN 0.3e0 ELSE 0e0 END AS score FROM rows),
r AS (SELECT query, doc, i, 1 AS k, len, 1 AS n, score FROM sc
 UNION ALL SELECT query, doc, i, 2, sum(len) OVER w2, count(*) OVER w2, sum(score) OVER w2 * 1.15e0 FROM sc WINDOW w2 AS (PARTITION BY query, doc ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)
 UNION ALL SELECT query, doc, i, 3, sum(len) OVER w3, count(*) OVER w3, sum(score) OVER w3 * 1.3e0 FROM sc WINDOW w3 AS (PARTITION BY query, doc ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT query, doc, i AS sentence, k AS n_sentences, round(score, 6) AS score FROM r WHERE n = k AND (len <= 320 OR k = 1) QUALIFY row_number() OVER (PARTITION BY query, doc ORDER BY round(score, 9) DESC, i, k) = 1""",
    "context_budget": _I + _Q + f""", first AS {S.top('bm25', 10)},
tt AS (SELECT note_id AS doc, coalesce(length(regexp_replace(body, '[^一-鿿]', '', 'g')) + length(regexp_replace(body, '[^A-Za-z0-9]', '', 'g')) // 4, 0) AS t FROM note_record),
b AS (SELECT query, doc, rank, t, coalesce(sum(t) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM first JOIN tt USING (doc))
SELECT query, doc, rank, CAST(least(t, 1500 - before) AS BIGINT) AS tokens FROM b WHERE before + t <= 1500 OR (1500 - before > 50 AND before < 1500)""",
}
