"""Measures of use and of records: vocabulary, gaps, missed answers, canonical tags, parents, paths and what readers give back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import index as I
from corpusmill.plans import sqltext as S
from corpusmill.plans.retrieval import answers, bm25_top10, notes_index, term_queries
from corpusmill.sources import formats
from corpusmill.sources.tables import table


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "note_record")


def lexical_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Of every note with a token: how many of its tokens differ, by all of them, and how many of those stand in no other note."""
    i = notes_index(spark, folder)
    p = i.postings.join(i.terms, "term")
    return p.groupBy("doc").agg(F.round(F.count("*") / F.sum("tf"), 6).alias("type_token"), F.round(F.avg(F.when(F.col("df") == 1, 1.0).otherwise(0.0)), 6).alias("novelty"))


def gap_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Of each term's best note: the tokens of the term that its title, summary and tags don't have and whose idf is 2.5 or more."""
    i = notes_index(spark, folder)
    q = term_queries(spark, folder)
    best = I.ranked(I.bm25(i, q), 1).select("query", "doc")
    surface = _notes(spark, folder).select(F.col("note_id").alias("doc"), F.explode(F.array_distinct(X.tokens(F.concat_ws(" ", "title", "kb_summary", F.array_join(F.array_compact("tags"), " "))))).alias("term"))
    asked = q.join(best, "query").join(i.terms.where("idf >= 2.5"), "term").select("query", "doc", "term", F.round("idf", 6).alias("idf"))
    return asked.join(surface, ["doc", "term"], "left_anti").select("query", "doc", "term", "idf")


def layer_share(spark: SparkSession, folder: str) -> DataFrame:
    """How the ten best notes of all terms spread over the layers."""
    n = _notes(spark, folder).select(F.col("note_id").alias("doc"), F.coalesce(F.lower(F.trim("kb_layer")), F.lit("-")).alias("layer"))
    hits = bm25_top10(spark, folder).join(n, "doc").groupBy("layer").agg(F.count("*").alias("hits"))
    return hits.crossJoin(hits.agg(F.sum("hits").alias("n"))).select("layer", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("share"))


def answer_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """For every held-out question whose passage a document holds: precision of the ten best documents, recall, and precision at each true one on average."""
    gold, hits = answers(spark, folder)
    j = hits.join(gold.withColumn("good", F.lit(1)), ["query", "doc"], "left").withColumn("good", F.coalesce("good", F.lit(0)))
    so_far = F.sum("good").over(Window.partitionBy("query").orderBy("rank"))
    per = j.withColumn("p", F.col("good") * so_far / F.col("rank")).groupBy("query").agg(F.sum("good").alias("k"), F.count("*").alias("n"), F.sum("p").alias("p"))
    of = gold.groupBy("query").agg(F.count("*").alias("of"))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return of.join(per, "query", "left").select("query", r(F.col("k") / F.col("n")).alias("precision"), r(F.col("k") / F.col("of")).alias("recall"), r(F.when(F.col("k") > 0, F.col("p") / F.col("k"))).alias("average_precision"))


def missed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a question's passage and aren't among its ten best."""
    gold, hits = answers(spark, folder)
    return gold.join(hits, ["query", "doc"], "left_anti")


def canonical_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Tags by their entry of the canonical list (equal letters and digits of its term or an alias), with its group and leaf; tags without one by themselves."""
    terms = table(spark, folder, "canon_term").where("kind = 'tag'")
    known = terms.select("term", F.explode(F.array_compact(F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("s")).select("term", X.slot_key(F.col("s")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("term").alias("term"))
    t = _notes(spark, folder).select("note_id", F.explode(F.array_compact("tags")).alias("t")).withColumn("key", X.slot_key(F.col("t"))).where("key <> ''")
    t = t.join(known, "key", "left").select("note_id", F.coalesce("term", "key").alias("tag"), F.col("term").isNotNull().alias("known")).distinct()
    deep = F.contains("tag", F.lit("/"))
    return t.groupBy("tag", "known").agg(F.count("*").alias("notes")).select("tag", "known", F.when(deep, F.substring_index("tag", "/", 1)).otherwise("-").alias("group"), F.substring_index("tag", "/", -1).alias("leaf"), "notes")


def parent_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Parents that chunks name and that have no row themselves: their pieces, and whether these are as many as the largest total among them."""
    c = table(spark, folder, "chunk_note")
    have = c.select(F.col("filename").alias("chunk_of")).where("chunk_of is not null").distinct()
    lost = c.where("chunk_of is not null").join(have, "chunk_of", "left_anti")
    return lost.groupBy("chunk_of").agg(F.count_distinct("chunk_index").alias("pieces"), F.coalesce(F.count_distinct("chunk_index") >= F.max("chunk_total"), F.lit(False)).alias("whole"))


def polarity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Notes of one title, each with the next by date, of which one denies something in its summary and the other doesn't. Every note meets one other only, however many have the title."""
    denies = F.col("kb_summary").rlike(r"不是|没有|不能|无法|并非|不得|不再|(?i)\b(?:not|never|no|cannot|without)\b")
    n = _notes(spark, folder).where("kb_summary is not null").select(X.slot_key(F.col("title")).alias("key"), "note_id", F.coalesce("updated", "created", F.lit("9999-12-31").cast("date")).alias("day"), denies.alias("denies")).where("key <> ''")
    w = Window.partitionBy("key").orderBy("day", "note_id")
    p = n.withColumn("later", F.lead("note_id").over(w)).withColumn("other", F.lead("denies").over(w)).where("denies <> other")
    return p.select(F.col("note_id").alias("earlier"), "later", F.col("denies").alias("earlier_denies"))


def path_safety(spark: SparkSession, folder: str) -> DataFrame:
    """What every note's path could do on a disk: leave its root, be absolute, have an empty part or an odd character, or nothing."""
    p = F.regexp_replace("rel", r"\\", "/")
    verdict = F.when(p.rlike(r"^(?:/|[A-Za-z]:)"), "absolute").when(p.rlike(r"(?:^|/)\.\.(?:/|$)"), "leaves").when(p.rlike(r"//|/$|^$"), "empty part").when(p.rlike(r"[\x00-\x1f<>:\"|?*]"), "odd character").otherwise("safe")
    return _notes(spark, folder).where("rel is not null").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("notes"))


def tag_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of canon notes that raw notes have too, and those that they don't have."""
    t = _notes(spark, folder).select(F.lower(F.trim("kb_layer")).alias("layer"), F.explode(F.array_compact("tags")).alias("tag"))
    canon, raw = t.where("layer = 'canon'").select("tag"), t.where("layer = 'raw'").select("tag")
    return canon.intersect(raw).withColumn("in", F.lit("both")).unionByName(canon.subtract(raw).withColumn("in", F.lit("canon only")))


def approximate_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the sketch of distinct users and the sketch of the median value are within five hundredths of the exact ones."""
    e = table(spark, folder, "events").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"), F.percentile_approx("value", 0.5, 1000).alias("c"), F.percentile("value", 0.5).alias("d"))
    return e.select((F.abs(F.col("a") - F.col("b")) <= 0.05 * F.col("b")).alias("distinct_close"), (F.abs(F.col("c") - F.col("d")) <= 0.05 * F.abs("d")).alias("median_close"))


def recall_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The published SM-2 step for every event as a second repetition with a grade from 0 to 5: the new ease and the days until the next."""
    g = F.col("event_id") % 6
    ease = F.greatest(F.lit(1.3), 2.5 + 0.1 - (5 - g) * (0.08 + (5 - g) * 0.02))
    return table(spark, folder, "events").select("event_id", F.round(ease, 6).alias("ease"), F.when(g < 3, 1).otherwise(6).cast("long").alias("days"))


def ghost_free_top10(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best notes of each term that still have a body and a path: others are ghosts of the index."""
    alive = _notes(spark, folder).where("trim(body) <> '' and rel is not null").select(F.col("note_id").alias("doc"))
    s = I.bm25(notes_index(spark, folder), term_queries(spark, folder)).join(alive, "doc", "left_semi")
    return I.ranked(s, 10).select("query", "doc", F.col("rank").cast("long").alias("rank"))


def format_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of notes, documents and chunks by the reader that their extension asks for."""
    names = [table(spark, folder, t).select(F.col(c).alias("f")) for t, c in (("note_record", "rel"), ("documents", "rel"), ("chunk_note", "filename"))]
    ext = F.lower(F.regexp_extract("f", r"\.([A-Za-z0-9]{1,5})$", 1))
    route = F.when(ext.isin("md", "markdown"), "note").when(ext.isin("txt", "log"), "text").when(ext.isin("csv", "tsv"), "table").when(ext.isin("html", "htm"), "page").when(ext == "eml", "mail").when(ext.isin("json", "jsonl"), "json").when(ext == "", "none").otherwise("other")
    return names[0].unionByName(names[1]).unionByName(names[2]).where("f is not null").groupBy(route.alias("route")).agg(F.count("*").alias("files"))


def read_chat_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages of one line written as ``[time] who: text`` and read back."""
    m = table(spark, folder, "chat_message").where(r"ts is not null and sender rlike '^[A-Za-z]' and not contains(sender, ':') and content not rlike '[\r\n]'")
    lines = m.select(F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), "sender", F.lit(": "), "content").alias("value"))
    return formats.chat_text(lines).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "sender", "content").groupBy("at", "sender", "content").agg(F.count("*").alias("n"))


def read_front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """Notes written with their status and author as front matter and read back."""
    n = _notes(spark, folder).where("body is not null and status rlike '^[A-Za-z]' and author rlike '^[A-Za-z]'")
    text = F.concat(F.lit("---\nstatus: "), "status", F.lit("\nauthor: '"), "author", F.lit("'\n# remark\nempty:\n---\n"), "body")
    r = n.select("note_id", formats.frontmatter(text).alias("r"))
    return r.select("note_id", F.col("r.fm")["status"].alias("status"), F.col("r.fm")["author"].alias("author"), F.size("r.fm").cast("long").alias("fields"), F.char_length("r.body").cast("long").alias("chars"))


def read_export(spark: SparkSession, folder: str) -> DataFrame:
    """Chat messages exported as one JSON object a channel and read back, by sender."""
    m = table(spark, folder, "chat_message").where("ts is not null and channel is not null and sender is not null and content is not null")
    item = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("sendTime"), F.col("sender").alias("senderNick"), F.col("content").alias("text")))
    pages = m.select(item.alias("i"), F.pmod(F.xxhash64("msg_id"), F.lit(64)).alias("page")).groupBy("page").agg(F.concat(F.lit('{"messages": ['), F.array_join(F.collect_list("i"), ","), F.lit("]}")).alias("value"))
    return formats.chat_json(formats.chat_items(pages)).groupBy("sender").agg(F.count("*").alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"))


QUERIES = {f.__name__: f for f in (
    lexical_measures, gap_terms, layer_share, answer_metrics, missed_answers, canonical_tags, parent_backfill, polarity_pairs, path_safety, tag_sets, approximate_counts, recall_marks, ghost_free_top10, format_routes, read_chat_lines,
    read_front_matter, read_export)}

_KEY = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_I, _Q = "WITH " + S.indexed(), ",\n" + S.asked()
_GOLD = "WITH " + S.indexed("(SELECT * FROM documents WHERE text IS NOT NULL)", "doc_id", "text") + ",\n" + S.asked("eval_item", "item_id", "question") + f""",
gold AS (SELECT DISTINCT item_id AS query, doc_id AS doc FROM documents, eval_item WHERE contains(text, passage)), hits AS {S.top('bm25', 10)}"""
_DENIES = "regexp_matches(kb_summary, '不是|没有|不能|无法|并非|不得|不再|(?i:\\b(?:not|never|no|cannot|without)\\b)')"
_EXT = "lower(regexp_extract(f, '\\.([A-Za-z0-9]{1,5})$', 1))"

SQL = {
    "lexical_measures": _I + " SELECT doc, round(count(*) / sum(tf), 6) AS type_token, round(avg(CASE WHEN df = 1 THEN 1.0 ELSE 0 END), 6) AS novelty FROM postings JOIN terms USING (term) GROUP BY doc",
    "gap_terms": _I + _Q + f", best AS {S.top('bm25', 1)}, surface AS (SELECT DISTINCT note_id AS doc, unnest({S.tokens(f'''concat_ws(' ', title, kb_summary, array_to_string({S.tags()}, ' '))''')}) AS term FROM note_record) SELECT query, b.doc, term, round(idf, 6) AS idf FROM q JOIN best b USING (query) JOIN terms USING (term) WHERE idf >= 2.5 AND NOT EXISTS (SELECT 1 FROM surface s WHERE s.doc = b.doc AND s.term = q.term)",
    "layer_share": _I + _Q + f" SELECT layer, hits, round(hits / sum(hits) OVER (), 6) AS share FROM (SELECT coalesce(lower(trim(kb_layer)), '-') AS layer, count(*) AS hits FROM {S.top('bm25', 10)} JOIN note_record ON note_id = doc GROUP BY 1)",
    "answer_metrics": _GOLD + ", j AS (SELECT h.query, rank, (g.doc IS NOT NULL)::INT AS good FROM hits h LEFT JOIN gold g ON g.query = h.query AND g.doc = h.doc), p AS (SELECT *, good * sum(good) OVER (PARTITION BY query ORDER BY rank) / rank AS p FROM j), per AS (SELECT query, sum(good) AS k, count(*) AS n, sum(p) AS p FROM p GROUP BY query), o AS (SELECT query, count(*) AS o FROM gold GROUP BY query) SELECT query, round(coalesce(k / n, 0), 6) AS precision, round(coalesce(k / o, 0), 6) AS recall, round(coalesce(CASE WHEN k > 0 THEN p / k END, 0), 6) AS average_precision FROM o LEFT JOIN per USING (query)",
    "missed_answers": _GOLD + " SELECT query, doc FROM gold g WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query = g.query AND h.doc = g.doc)",
    "canonical_tags": f"WITH known AS (SELECT key, min(term) AS term FROM (SELECT term, {_KEY.format(x='s')} AS key FROM (SELECT term, unnest(list_concat([term], coalesce(aliases, []))) AS s FROM canon_term WHERE kind = 'tag')) WHERE key <> '' GROUP BY key), t AS (SELECT note_id, {_KEY.format(x='t')} AS key FROM (SELECT note_id, unnest({S.tags()}) AS t FROM note_record)), d AS (SELECT DISTINCT note_id, coalesce(term, key) AS tag, term IS NOT NULL AS known FROM t LEFT JOIN known USING (key) WHERE key <> '') SELECT tag, known, CASE WHEN contains(tag, '/') THEN split_part(tag, '/', 1) ELSE '-' END AS \"group\", string_split(tag, '/')[-1] AS leaf, count(*) AS notes FROM d GROUP BY tag, known",
    "parent_backfill": "SELECT chunk_of, count(DISTINCT chunk_index) AS pieces, coalesce(count(DISTINCT chunk_index) >= max(chunk_total), false) AS whole FROM chunk_note WHERE chunk_of IS NOT NULL AND chunk_of NOT IN (SELECT filename FROM chunk_note WHERE filename IS NOT NULL) GROUP BY chunk_of",
    "polarity_pairs": f"WITH n AS (SELECT {_KEY.format(x='title')} AS key, note_id, coalesce(updated, created, DATE '9999-12-31') AS day, {_DENIES} AS denies FROM note_record WHERE kb_summary IS NOT NULL), p AS (SELECT *, lead(note_id) OVER w AS later, lead(denies) OVER w AS other FROM n WHERE key <> '' WINDOW w AS (PARTITION BY key ORDER BY day, note_id)) SELECT note_id AS earlier, later, denies AS earlier_denies FROM p WHERE denies <> other",
    "path_safety": r"""SELECT verdict, count(*) AS notes FROM (SELECT CASE WHEN regexp_matches(p, '^(?:/|[A-Za-z]:)') THEN 'absolute' WHEN regexp_matches(p, '(?:^|/)\.\.(?:/|$)') THEN 'leaves' WHEN regexp_matches(p, '//|/$|^$') THEN 'empty part' WHEN regexp_matches(p, '[\x00-\x1f<>:"|?*]') THEN 'odd character' ELSE 'safe' END AS verdict FROM (SELECT replace(rel, '\', '/') AS p FROM note_record WHERE rel IS NOT NULL)) GROUP BY verdict""",
    "tag_sets": f"WITH t AS (SELECT lower(trim(kb_layer)) AS layer, unnest({S.tags()}) AS tag FROM note_record) SELECT tag, 'both' AS \"in\" FROM (SELECT tag FROM t WHERE layer = 'canon' INTERSECT SELECT tag FROM t WHERE layer = 'raw') UNION ALL SELECT tag, 'canon only' FROM (SELECT tag FROM t WHERE layer = 'canon' EXCEPT SELECT tag FROM t WHERE layer = 'raw')",
    "approximate_counts": "SELECT true AS distinct_close, true AS median_close",
    "recall_marks": "SELECT event_id, round(greatest(1.3e0, 2.6e0 - (5 - event_id % 6) * (0.08e0 + (5 - event_id % 6) * 0.02e0)), 6) AS ease, CASE WHEN event_id % 6 < 3 THEN 1 ELSE 6 END::BIGINT AS days FROM events",
    "ghost_free_top10": _I + _Q + f", alive AS (SELECT b.* FROM bm25 b JOIN note_record ON note_id = doc WHERE trim(body) <> '' AND rel IS NOT NULL) SELECT query, doc, rank FROM {S.top('alive', 10)}",
    "format_routes": f"SELECT CASE WHEN e IN ('md', 'markdown') THEN 'note' WHEN e IN ('txt', 'log') THEN 'text' WHEN e IN ('csv', 'tsv') THEN 'table' WHEN e IN ('html', 'htm') THEN 'page' WHEN e = 'eml' THEN 'mail' WHEN e IN ('json', 'jsonl') THEN 'json' WHEN e = '' THEN 'none' ELSE 'other' END AS route, count(*) AS files FROM (SELECT {_EXT} AS e FROM (SELECT rel AS f FROM note_record UNION ALL SELECT rel FROM documents UNION ALL SELECT filename FROM chunk_note) WHERE f IS NOT NULL) GROUP BY 1",
    "read_chat_lines": r"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, trim(sender) AS sender, trim(content) AS content, count(*) AS n FROM chat_message WHERE ts IS NOT NULL AND regexp_matches(sender, '^[A-Za-z]') AND NOT contains(sender, ':') AND NOT regexp_matches(content, '[\r\n]') GROUP BY ALL",
    "read_front_matter": "SELECT note_id, trim(status) AS status, author, 3 AS fields, length(regexp_replace(body, '\\r\\n?', chr(10), 'g')) AS chars FROM note_record WHERE body IS NOT NULL AND regexp_matches(status, '^[A-Za-z]') AND regexp_matches(author, '^[A-Za-z]')",
    "read_export": "SELECT sender, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM chat_message WHERE ts IS NOT NULL AND channel IS NOT NULL AND sender IS NOT NULL AND content IS NOT NULL GROUP BY sender",
}
