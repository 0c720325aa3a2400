"""Likeness, links and time: joins of notes, chunks, orders and events with themselves and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import bags as B
from corpusmill.operators import graph as G
from corpusmill.operators import index as I
from corpusmill.operators import similarity as J
from corpusmill.operators import sketches as K
from corpusmill.operators import temporal as T
from corpusmill.operators.sessions import micros, sessions
from corpusmill.plans import sqltext as S
from corpusmill.plans.retrieval import note_text, note_words
from corpusmill.sources.tables import cut, evenly, shared_out, state_of, table

DAY = 86_400_000_000


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "note_record")


def _copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    flat = _notes(spark, folder).where("body is not null").select(F.col("note_id").alias("id"), F.regexp_replace("body", r"\s+", "").alias("t"))
    return K.classes(flat.where("t <> ''"))


def near_dups_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes whose five-character shingles have Jaccard 0.7 or more, with containment and whether one is a section of the other.

    Bodies that are equal but for white space are given by their smallest id; ``near_dups_members`` has the rest.
    """
    p = K.near_texts(_copies(spark, folder)[1], 0.7)
    kind = F.when((F.col("containment") >= 0.9) & (F.col("score") < 0.85), "section-dup").otherwise("near-dup")
    return p.select("a", "b", F.round("score", 6).alias("jaccard"), F.round("containment", 6).alias("containment"), kind.alias("kind"))


def near_dups_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every note with a body: the smallest note whose body is equal but for white space, how many are, and how many other bodies are near-duplicates of it."""
    members, first = _copies(spark, folder)
    links = K.near_texts(first, 0.7).select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("k"))
    return members.join(links, "rep", "left").select(F.col("id").alias("note_id"), F.col("rep").alias("class_id"), F.col("n").alias("n_copies"), F.coalesce("k", F.lit(0).cast("long")).alias("n_links"))


def note_blocks(spark: SparkSession, folder: str) -> B.Blocks:
    """The vectors of all notes with their tags, author and link targets as marks, stored once an application and state of the table."""
    marks = {"shares_tag": F.array_compact("tags"), "same_author": F.array_compact(F.array("author")), "co_ref": X.wiki_targets(F.col("body"))}
    return I.stored(spark, ("note blocks", *state_of(spark, folder, "note_record")), lambda: B.text_blocks(shared_out(spark, folder, "note_record", "note_id"), "note_id", note_text(), **marks))


def alike_notes(spark: SparkSession, folder: str) -> DataFrame:
    """``a, b, cosine`` of the pairs of notes with cosine 0.70 or more, joined once an application and state of the table."""
    return I.stored(spark, ("alike", *state_of(spark, folder, "note_record")), lambda: I.written(B.alike(note_blocks(spark, folder), 0.70).select("a", "b", "cosine"), name="alike"))


def cosine_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes with tf-idf cosine 0.75 or more, and whether their domains differ."""
    d = _notes(spark, folder).select("note_id", F.split_part(F.coalesce("domain", F.lit("-")), F.lit("/"), F.lit(1)).alias("d"))
    p = alike_notes(spark, folder).where("cosine >= 0.75")
    p = p.join(d.select(F.col("note_id").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("note_id").alias("b"), F.col("d").alias("db")), "b")
    return p.select("a", "b", F.round("cosine", 5).alias("cosine"), ((F.col("da") != F.col("db")) & (F.col("da") != "-") & (F.col("db") != "-")).alias("crosses"))


def related_band(spark: SparkSession, folder: str) -> DataFrame:
    """For every note at most three others that are alike (0.70) but no copies (0.92), the most alike first."""
    p = B.alike(note_blocks(spark, folder), 0.70).where("cosine < 0.92")
    # the window keeps the best three within the tasks that join, so pairs are neither stored nor shuffled
    both = p.select(F.inline(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))))
    w = Window.partitionBy("a").orderBy(F.round("cosine", 7).desc(), "b")
    return both.withColumn("r", F.row_number().over(w)).where("r <= 3").select(F.col("a").alias("note_id"), F.col("b").alias("related"), F.col("r").cast("long").alias("place"))


def knn_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest other notes of every hundredth note, against all."""
    q = B.asked_terms(_notes(spark, folder).where("note_id % 100 = 0"), "note_id", note_text())
    rows = B.bags(shared_out(spark, folder, "note_record", "note_id"), "note_id", note_text())
    return B.nearest(rows, note_words(spark, folder), q, "cosine", 3, 7).select("query", "doc", F.round("score", 5).alias("score"))


def set_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """Jaccard, Dice and recall of the tags of the pairs of an earlier run."""
    n = _notes(spark, folder).groupBy("rel").agg(F.max(F.coalesce(F.array_compact("tags"), F.array().cast("array<string>"))).alias("t"))
    p = table(spark, folder, "sim_result").where("from_rel is not null and to_rel is not null").select("from_rel", "to_rel").distinct()
    p = p.join(n.select(F.col("rel").alias("from_rel"), F.array_distinct("t").alias("a")), "from_rel").join(n.select(F.col("rel").alias("to_rel"), F.array_distinct("t").alias("b")), "to_rel")
    i, u = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    r = lambda x, y: F.round(F.when(y > 0, x / y).otherwise(0.0), 6)
    return p.select("from_rel", "to_rel", r(i, u).alias("jaccard"), r(2 * i, F.size("a") + F.size("b")).alias("dice"), r(i, F.size("a")).alias("recall"))


#: Words that say that something has changed.
CHANGE = (
    "改为", "改成", "换成", "替换为", "不再是", "已经不用", "停止使用", "改为使用", "修正为", "更正为", "已废弃", "已停用", "弃用", "作废", "废弃", "停用", "推翻", "取代", "纠正", "误判", "有误", "错了", "过时",
    "superseded", "deprecated", "no longer", "replaced by", "changed to")


def _conclusions(body: Column) -> Column:
    """The text below the second-level headings that begin with a word for conclusions; the whole body where there is none."""
    sections = F.filter(F.split(body, r"(?m)^(?=##[^\S\r\n]+\S)"), lambda x: x.rlike(r"^##[^\S\r\n]+(?:结论|决定|要点|现象|根因)"))
    text = F.array_join(F.transform(sections, lambda x: F.regexp_replace(x, r"^[^\r\n]*", "")), "\n")
    return F.when(X.strip(text) != "", text).otherwise(body)


def contradiction_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Canon notes of one domain (or with none) whose conclusions have Jaccard 0.25 or more and of which one's have a word of change: the older and the newer one.

    The table has neither parents nor source references, so notes of one family or source are not told apart.
    Every note with a word of change meets each of its domain once: at 0.25 a prefix would hold three quarters of the tokens.
    """
    n = _notes(spark, folder).where("lower(trim(kb_layer)) = 'canon' and body is not null").select(
        "note_id", F.nullif(X.strip(F.col("domain")), F.lit("")).alias("domain"), F.coalesce("updated", "created", F.lit("9999-12-31").cast("date")).alias("day"), _conclusions(F.col("body")).alias("t"))
    n = cut(n.select("note_id", "domain", "day", F.exists(F.array(*map(F.lit, CHANGE)), lambda w: F.contains(F.lower("t"), w)).alias("change"), J.hashed(X.tokens(F.col("t"))).alias("s")).where("size(s) > 0"))
    own = F.concat(F.lit("="), "domain")
    # a note with a domain meets those of its domain and those without; one without meets all
    x = n.where("change").withColumn("key", F.explode(F.when(F.col("domain").isNull(), F.array(F.lit("all"))).otherwise(F.array(own, F.lit("none")))))
    y = n.withColumn("key", F.explode(F.array(F.coalesce(own, F.lit("none")), F.lit("all"))))
    p, q = evenly(x, "key").alias("p"), evenly(y, "key").alias("q")
    once = (F.col("p.note_id") != F.col("q.note_id")) & (~F.col("q.change") | (F.col("p.note_id") < F.col("q.note_id")))
    shared = F.size(F.array_intersect("p.s", "q.s"))
    jaccard = shared / (F.size("p.s") + F.size("q.s") - shared)
    first = F.struct("p.day", "p.note_id") < F.struct("q.day", "q.note_id")
    met = p.join(q, (F.col("p.key") == F.col("q.key")) & once).select(
        F.when(first, F.col("p.note_id")).otherwise(F.col("q.note_id")).alias("older"), F.when(first, F.col("q.note_id")).otherwise(F.col("p.note_id")).alias("newer"), jaccard.alias("jaccard")).where("jaccard >= 0.25")
    return met.select("older", "newer", F.round("jaccard", 6).alias("jaccard"), F.when(F.col("jaccard") >= 0.85, "same").otherwise("changed").alias("kind"))


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("relation"), F.col("o_orderstatus").alias("value"), day.alias("s"), (day + 30).alias("e"))


def claim_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of one subject and relation whose validity overlaps: duplicates or, with different values, conflicts."""
    c = _claims(spark, folder)
    p = T.overlapping_pairs(c, "id", ["subject", "relation"], "s", "e", 30)
    v = c.select("id", "value")
    p = p.join(v.select(F.col("id").alias("a"), F.col("value").alias("va")), "a").join(v.select(F.col("id").alias("b"), F.col("value").alias("vb")), "b")
    return p.select("a", "b", F.when(F.col("va") == F.col("vb"), "dup").otherwise("conflict").alias("kind"))


def claim_updates(spark: SparkSession, folder: str) -> DataFrame:
    """Claims followed by the next one of their subject and relation that doesn't overlap and has another value."""
    w = Window.partitionBy("subject", "relation").orderBy("s", "id")
    c = _claims(spark, folder).withColumn("b", F.lead("id").over(w)).withColumn("vb", F.lead("value").over(w)).withColumn("sb", F.lead("s").over(w))
    return c.where("sb > e and vb <> value").select(F.col("id").alias("a"), "b", (F.col("sb") - F.col("s")).alias("days"))


def claim_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Every order with its customer's latest earlier event, if any."""
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), micros(F.col("o_orderdate")).alias("t"))
    e = table(spark, folder, "events").select(F.col("user_id").alias("k"), micros(F.col("ts")).alias("t"), "event_id")
    out = T.as_of(o, e, "k", "t", "event_id", 30 * DAY, strict=True)
    return out.select("o_orderkey", "event_id", (F.col("t") - F.col("at_right")).alias("micros"))


def requery_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose user does the same again within an hour, with the next time."""
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", micros(F.col("ts")).alias("t"))
    return T.next_within(e, "event_id", ["user_id", "event_type"], "t", 3_600_000_000).select("a", "b", (F.col("gap") / 1_000_000).cast("long").alias("seconds"))


def requery_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Share of events that are done again within an hour, by type."""
    e = table(spark, folder, "events")
    again = requery_pairs(spark, folder).select(F.col("a").alias("event_id"), F.lit(1).alias("again"))
    return e.select("event_id", "event_type").join(again, "event_id", "left").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg(F.coalesce("again", F.lit(0))), 6).alias("rate"))


def gap_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users: events at most half an hour apart."""
    e = table(spark, folder, "events").select(F.col("user_id").cast("string").alias("user"), "ts", "event_id")
    return sessions(e, "user", "ts", "event_id").select("user", "start_time", "end_time", F.col("n_events").cast("long").alias("n_events"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Links of notes as stems: a stem is the path's last part without its running number."""
    n = _notes(spark, folder)
    return n.where("body is not null").select(_stem().alias("src"), F.explode(X.wiki_targets(F.col("body"))).alias("dst")).distinct()


def _stem():  # noqa: ANN202
    return F.regexp_replace(X.path_stem(F.col("rel")), "-[0-9a-z]{6}$", "")


def link_degrees(spark: SparkSession, folder: str) -> DataFrame:
    """Links from and to every stem."""
    return G.degrees(_edges(spark, folder), "src", "dst")


def dead_links(spark: SparkSession, folder: str) -> DataFrame:
    """Link targets that are no note's stem or title, with how many stems point there."""
    n = _notes(spark, folder)
    names = n.select(_stem().alias("dst")).unionByName(n.where("title is not null").select(F.col("title").alias("dst"))).distinct()
    return _edges(spark, folder).join(names, "dst", "left_anti").groupBy("dst").agg(F.count("*").alias("n"))


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Stems that neither link nor are linked to."""
    e = _edges(spark, folder)
    n = _notes(spark, folder).where("rel is not null").select(_stem().alias("stem")).distinct()
    return n.join(e.select(F.col("src").alias("stem")), "stem", "left_anti").join(e.select(F.col("dst").alias("stem")), "stem", "left_anti")


def two_hop_reach(spark: SparkSession, folder: str) -> DataFrame:
    """What two links reach from the stems of canon notes."""
    starts = _notes(spark, folder).where("lower(trim(kb_layer)) = 'canon'").select(_stem().alias("id"))
    return G.reachable(_edges(spark, folder), "src", "dst", starts, 2).where("hops > 0")


def link_components(spark: SparkSession, folder: str) -> DataFrame:
    """Stems that links tie together, whichever way: the first stem of the component of each."""
    return G.components(_edges(spark, folder), "src", "dst").select(F.col("id").alias("stem"), "component")


def chunk_roots(spark: SparkSession, folder: str) -> DataFrame:
    """The root file of every chunk, following parents up to eight times."""
    c = table(spark, folder, "chunk_note").where("filename is not null").select("filename", "chunk_of").groupBy("filename").agg(F.max("chunk_of").alias("chunk_of"))
    return G.roots(c, "filename", "chunk_of").select(F.col("id").alias("filename"), "root", "hops")


def tag_cohesion(spark: SparkSession, folder: str) -> DataFrame:
    """Tags of five or more stems: links among them by possible links."""
    t = _notes(spark, folder).select(_stem().alias("stem"), F.explode(F.array_compact("tags")).alias("tag")).distinct()
    size = t.groupBy("tag").agg(F.count("*").alias("n")).where("n >= 5")
    e = _edges(spark, folder)
    inside = e.join(t.select(F.col("stem").alias("src"), "tag"), "src").join(t.select(F.col("stem").alias("dst"), F.col("tag").alias("tag2")), "dst").where("tag = tag2 and src <> dst").groupBy("tag").agg(F.count("*").alias("k"))
    return size.join(inside, "tag", "left").select("tag", "n", F.round(F.coalesce("k", F.lit(0)) / (F.col("n") * (F.col("n") - 1)), 6).alias("cohesion"))


def link_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Alike notes with the signals for a link between them: shared tags, same author, shared link targets, likeness; kept with two signals of which one is structural."""
    p = B.alike(note_blocks(spark, folder), 0.70)
    p = p.select("a", "b", "shares_tag", "same_author", "co_ref", (F.round("cosine", 5) >= 0.75).alias("near"))
    return p.where("(shares_tag or same_author or co_ref) and (cast(shares_tag as int) + cast(same_author as int) + cast(co_ref as int) + cast(near as int)) >= 2")


QUERIES = {f.__name__: f for f in (
    near_dups_jaccard, near_dups_members, cosine_pairs, related_band, knn_notes, set_likeness, contradiction_pairs, claim_overlaps, claim_updates, claim_evidence, requery_pairs, requery_rate, gap_sessions,
    link_degrees, dead_links, orphans, two_hop_reach, link_components, chunk_roots, tag_cohesion, link_gate)}

_SH = "list_distinct(CASE WHEN length(f) = 0 THEN [] WHEN length(f) <= 5 THEN [f] ELSE list_transform(range(1, length(f) - 3), lambda i: substr(f, i, 5)) END)"
_JAC = """{sets}, x AS (SELECT id, unnest(s) AS x FROM sets), n AS (SELECT id, len(s) AS n FROM sets),
sh AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM x p JOIN x q ON p.x = q.x AND p.id < q.id GROUP BY a, b),
jac AS (SELECT a, b, k, k / (na.n + nb.n - k) AS jaccard, k / least(na.n, nb.n) AS containment FROM sh JOIN n na ON a = na.id JOIN n nb ON b = nb.id)"""
_NEAR = _JAC.format(sets=f"flat AS (SELECT note_id, regexp_replace(body, '\\s+', '', 'g') AS f FROM note_record WHERE regexp_replace(body, '\\s+', '', 'g') <> ''), sets AS (SELECT id, {_SH} AS s FROM (SELECT min(note_id) AS id, f FROM flat GROUP BY f))")
_COS = "WITH " + S.indexed() + """, v AS (SELECT doc, term, tf * idf / norm AS w FROM postings JOIN terms USING (term) JOIN docs USING (doc)),
cos AS (SELECT p.doc AS a, q.doc AS b, sum(p.w * q.w) AS cosine FROM v p JOIN v q ON p.term = q.term AND p.doc < q.doc GROUP BY 1, 2)"""
_STEM = "regexp_replace(regexp_replace(regexp_replace(replace(rel, '\\', '/'), '^.*/', '', 's'), '\\.[A-Za-z0-9]{1,5}$', ''), '-[0-9a-z]{6}$', '')"
_PLAIN = "regexp_replace(regexp_replace(body, '(?s)```.*?(?:```|\\z)', '', 'g'), '`[^`\\n]*`', '', 'g')"
_OUT = f"list_filter(list_transform(regexp_extract_all({_PLAIN}, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(regexp_extract(x, '^[^#|]*'))), lambda x: x <> '')"
_EDGES = f"edges AS (SELECT DISTINCT src, dst FROM (SELECT {_STEM} AS src, unnest(list_filter(list_transform(regexp_extract_all({_PLAIN}, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(regexp_extract(x, '^[^#|]*'))), lambda x: x <> '')) AS dst FROM note_record))"
_CLAIMS = "claims AS (SELECT o_orderkey AS id, o_custkey AS subject, o_orderpriority AS relation, o_orderstatus AS value, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 30 AS e FROM orders)"
_STRIP = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_REQ = "req AS (SELECT event_id AS a, lead(event_id) OVER w AS b, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"

SQL = {
    "near_dups_jaccard": "WITH " + _NEAR + " SELECT a, b, round(jaccard, 6) AS jaccard, round(containment, 6) AS containment, CASE WHEN containment >= 0.9 AND jaccard < 0.85 THEN 'section-dup' ELSE 'near-dup' END AS kind FROM jac WHERE jaccard >= 0.7",
    "near_dups_members": "WITH " + _NEAR + ", k AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM jac WHERE jaccard >= 0.7 UNION ALL SELECT b FROM jac WHERE jaccard >= 0.7) GROUP BY id) SELECT note_id, class_id, n AS n_copies, coalesce(k, 0) AS n_links FROM flat JOIN (SELECT f, min(note_id) AS class_id, count(*) AS n FROM flat GROUP BY f) USING (f) LEFT JOIN k ON id = class_id",
    "cosine_pairs": _COS + " SELECT a, b, round(cosine, 5) AS cosine, da <> db AND da <> '-' AND db <> '-' AS crosses FROM cos JOIN (SELECT note_id AS a, split_part(coalesce(domain, '-'), '/', 1) AS da FROM note_record) USING (a) JOIN (SELECT note_id AS b, split_part(coalesce(domain, '-'), '/', 1) AS db FROM note_record) USING (b) WHERE cosine >= 0.75",
    "related_band": _COS + " SELECT a AS note_id, b AS related, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 7) DESC, b) AS place FROM (SELECT a, b, cosine FROM cos UNION ALL SELECT b, a, cosine FROM cos) WHERE cosine >= 0.70 AND cosine < 0.92 QUALIFY place <= 3",
    "knn_notes": "WITH " + S.indexed() + ",\n" + S.asked("note_record", "note_id", S.NOTE_TEXT, "note_id % 100 = 0") + " SELECT query, doc, round(score, 5) AS score FROM cosine WHERE query <> doc QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 7) DESC, doc) <= 3",
    "set_likeness": f"WITH n AS (SELECT rel, list_distinct(max(coalesce({S.tags()}, []))) AS t FROM note_record GROUP BY rel), p AS (SELECT DISTINCT from_rel, to_rel, x.t AS a, y.t AS b, len(list_intersect(x.t, y.t)) AS i, len(list_distinct(list_concat(x.t, y.t))) AS u FROM sim_result JOIN n x ON from_rel = x.rel JOIN n y ON to_rel = y.rel) SELECT from_rel, to_rel, round(CASE WHEN u > 0 THEN i / u ELSE 0 END, 6) AS jaccard, round(CASE WHEN len(a) + len(b) > 0 THEN 2 * i / (len(a) + len(b)) ELSE 0 END, 6) AS dice, round(CASE WHEN len(a) > 0 THEN i / len(a) ELSE 0 END, 6) AS recall FROM p",
    "claim_overlaps": f"WITH {_CLAIMS} SELECT x.id AS a, y.id AS b, CASE WHEN x.value = y.value THEN 'dup' ELSE 'conflict' END AS kind FROM claims x JOIN claims y ON x.subject = y.subject AND x.relation = y.relation AND x.id < y.id AND x.s <= y.e AND y.s <= x.e",
    "claim_updates": f"WITH {_CLAIMS} SELECT a, b, sb - s AS days FROM (SELECT id AS a, s, e, value, lead(id) OVER w AS b, lead(value) OVER w AS vb, lead(s) OVER w AS sb FROM claims WINDOW w AS (PARTITION BY subject, relation ORDER BY s, id)) WHERE sb > e AND vb <> value",
    "claim_evidence": "WITH e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY user_id, ts) SELECT o_orderkey, e.event_id, epoch_us(o_orderdate) - epoch_us(e.ts) AS micros FROM orders ASOF LEFT JOIN e ON o_custkey = user_id AND o_orderdate > e.ts",
    "requery_pairs": f"WITH {_REQ} SELECT a, b, gap // 1000000 AS seconds FROM req WHERE gap <= 3600000000",
    "requery_rate": f"WITH {_REQ} SELECT event_type, count(*) AS events, round(avg(CASE WHEN gap <= 3600000000 THEN 1 ELSE 0 END), 6) AS rate FROM events LEFT JOIN req ON a = event_id GROUP BY event_type",
    "gap_sessions": """WITH m AS (SELECT CAST(user_id AS VARCHAR) AS u, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS o FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(o) OVER (PARTITION BY u ORDER BY ts, o DESC ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT u AS "user", strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_time, count(*) AS n_events FROM s GROUP BY u, s""",
    "link_degrees": f"WITH {_EDGES} SELECT id, CAST(sum(o) AS BIGINT) AS outlinks, CAST(sum(i) AS BIGINT) AS inlinks FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id",
    "dead_links": f"WITH {_EDGES} SELECT dst, count(*) AS n FROM edges WHERE dst NOT IN (SELECT {_STEM} FROM note_record WHERE rel IS NOT NULL UNION SELECT title FROM note_record WHERE title IS NOT NULL) GROUP BY dst",
    "orphans": f"WITH {_EDGES} SELECT DISTINCT {_STEM} AS stem FROM note_record WHERE rel IS NOT NULL AND {_STEM} NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "two_hop_reach": f"WITH {_EDGES}, st AS (SELECT DISTINCT {_STEM} AS id FROM note_record WHERE lower(trim(kb_layer)) = 'canon'), h1 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM st) AND dst NOT IN (SELECT id FROM st)), h2 AS (SELECT DISTINCT dst AS id FROM edges WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM st UNION SELECT id FROM h1)) SELECT id, 1 AS hops FROM h1 UNION ALL SELECT id, 2 FROM h2",
    "link_components": f"WITH RECURSIVE {_EDGES}, e AS (SELECT src AS u, dst AS v FROM edges UNION SELECT dst, src FROM edges), r AS (SELECT u AS stem, u AS c FROM e UNION SELECT r.stem, e.v FROM r JOIN e ON r.c = e.u) SELECT stem, min(c) AS component FROM r GROUP BY stem",
    "chunk_roots": "WITH RECURSIVE c AS (SELECT filename, max(chunk_of) AS up FROM chunk_note WHERE filename IS NOT NULL GROUP BY filename), r AS (SELECT filename, filename AS root, 0 AS hops FROM c UNION ALL SELECT r.filename, c.up, hops + 1 FROM r JOIN c ON c.filename = r.root WHERE c.up IS NOT NULL AND c.up <> r.root AND c.up IN (SELECT filename FROM c) AND hops < 8) SELECT filename, arg_max(root, hops) AS root, max(hops) AS hops FROM r GROUP BY filename",
    "tag_cohesion": f"WITH {_EDGES}, t AS (SELECT DISTINCT {_STEM} AS stem, unnest({S.tags()}) AS tag FROM note_record), n AS (SELECT tag, count(*) AS n FROM t GROUP BY tag HAVING count(*) >= 5), k AS (SELECT p.tag, count(*) AS k FROM edges JOIN t p ON src = p.stem JOIN t q ON dst = q.stem AND p.tag = q.tag WHERE src <> dst GROUP BY p.tag) SELECT tag, n, round(coalesce(k, 0) / (n * (n - 1)), 6) AS cohesion FROM n LEFT JOIN k USING (tag)",
    "link_gate": _COS + f", nn2 AS (SELECT note_id, author, coalesce({S.tags()}, []) AS tags, coalesce({_OUT}, []) AS outs FROM note_record), g AS (SELECT a, b, list_has_any(x.tags, y.tags) AS shares_tag, coalesce(x.author = y.author, false) AS same_author, list_has_any(x.outs, y.outs) AS co_ref, round(cosine, 5) >= 0.75 AS near FROM cos JOIN nn2 x ON a = x.note_id JOIN nn2 y ON b = y.note_id WHERE cosine >= 0.70) SELECT * FROM g WHERE (shares_tag OR same_author OR co_ref) AND shares_tag::INT + same_author::INT + co_ref::INT + near::INT >= 2",
    "contradiction_pairs": f"""WITH parts AS (SELECT *, array_to_string(list_transform(list_filter(string_split(chr(10) || body, chr(10) || '## ')[2:], lambda x: regexp_matches(x, '^[ \t]*(?:结论|决定|要点|现象|根因)')), lambda x: regexp_replace(x, '^[^\r\n]*', '')), chr(10)) AS c FROM note_record WHERE lower(trim(kb_layer)) = 'canon' AND body IS NOT NULL),
cn AS (SELECT note_id AS id, nullif({_STRIP.format(x='domain')}, '') AS domain, coalesce(updated, created, DATE '9999-12-31') AS day, CASE WHEN {_STRIP.format(x='c')} <> '' THEN c ELSE body END AS t FROM parts), """ + _JAC.format(sets=f"sets AS (SELECT id, list_distinct({S.tokens('t')}) AS s FROM cn)") + f""", nd AS (SELECT id, domain, day, len(list_filter([{', '.join(f"'{w}'" for w in CHANGE)}], lambda w: contains(lower(t), w))) > 0 AS change FROM cn)
SELECT CASE WHEN first THEN a ELSE b END AS older, CASE WHEN first THEN b ELSE a END AS newer, round(jaccard, 6) AS jaccard, CASE WHEN jaccard >= 0.85 THEN 'same' ELSE 'changed' END AS kind FROM (SELECT *, x.day < y.day OR (x.day = y.day AND a < b) AS first FROM jac JOIN nd x ON a = x.id JOIN nd y ON b = y.id WHERE jaccard >= 0.25 AND (x.domain IS NULL OR y.domain IS NULL OR x.domain = y.domain) AND (x.change OR y.change))""",
}
