"""Queries over the tables of a data folder, and SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import canonical, conversations, formatting, leakage, near, reading, residue, splitting, tokens
from corpusmill.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Copies of notes that differ only in formatting, each with the first of its group."""
    return formatting.format_copies(table(spark, folder, "note_record")).where("first_id <> note_id").selectExpr("first_id", "note_id as copy_id")


def p1_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per note with the number of its copies."""
    return formatting.format_copies(table(spark, folder, "note_record")).where("first_id = note_id").select("note_id", "n_copies")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of notes whose bodies are near-duplicates."""
    return near.near_pairs(table(spark, folder, "note_record")).selectExpr("a as note_a", "b as note_b")


def p3_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs with their paths and scores, as in an earlier run's results."""
    notes = table(spark, folder, "note_record").select("note_id", "rel")
    pairs = near.near_pairs(table(spark, folder, "note_record"))
    pairs = pairs.join(notes.selectExpr("note_id as a", "rel as from_rel"), "a").join(notes.selectExpr("note_id as b", "rel as to_rel"), "b")
    return pairs.selectExpr("a as note_a", "b as note_b", "from_rel", "to_rel", "round(score, 6) as score")


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Every note's class of equal bodies, group of near-duplicates and number of links."""
    return near.near_groups(table(spark, folder, "note_record"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are template residue, filler, an error page or a scripts notice."""
    return residue.classify(table(spark, folder, "chunk_note")).where("reason is not null").select("chunk_id").distinct()


def p4_kept(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that stay when residue is kept out."""
    return residue.without_residue(table(spark, folder, "chunk_note")).select("chunk_id", "filename")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Turns of the whole conversations."""
    return conversations.conversation_turns(*(table(spark, folder, t) for t in ("oc_session", "oc_message", "oc_part"))).select("session_id", "turn_no", "message_id")


def p5_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The whole conversations with roles and texts."""
    return conversations.conversation_texts(*(table(spark, folder, t) for t in ("oc_session", "oc_message", "oc_part")))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that have to be cut: those the splitter makes pieces of."""
    return splitting.split_oversized(table(spark, folder, "chunk_note")).where("piece_no = 1").select("chunk_id")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the oversized chunks."""
    return splitting.split_oversized(table(spark, folder, "chunk_note")).select("chunk_id", "piece_no", "n_pieces", "piece")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-typed domains and tags with their entry of the canonical list."""
    return canonical.map_typed(table(spark, folder, "note_record"), table(spark, folder, "canon_term"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, folder, "documents").select("doc_id", "text"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold passages of held-out items."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reading level of every document with text."""
    return reading.reading_levels(table(spark, folder, "documents"), table(spark, folder, "doc_label"))


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p3_found, p3_scores, p3_groups, p4_found, p4_kept, p5_found, p5_texts, p6_found, p6_pieces, p7_found, p8_ids, p9_found, p10_found)}

_WINDOWS = """t AS (SELECT note_id AS id, regexp_replace(lower(body), '[\\s\\x0b\\x{85}\\p{Z}]+', '', 'g') AS f FROM note_record WHERE body IS NOT NULL),
w AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(f) - 3), lambda i: substr(f, i, 5))) AS x FROM t WHERE length(f) > 200),
n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
k AS (SELECT p.id AS a, q.id AS b, count(*) AS k FROM w p JOIN w q ON p.x = q.x AND p.id < q.id GROUP BY 1, 2),
near AS (SELECT a, b, k / (na.n + nb.n - k) AS score FROM k JOIN n na ON a = na.id JOIN n nb ON b = nb.id WHERE k / (na.n + nb.n - k) >= 0.7)"""
_TURNS = """m AS (SELECT DISTINCT id, session_id AS s, time_created AS t, data FROM oc_message WHERE session_id IS NOT NULL),
p AS (SELECT DISTINCT id, message_id, session_id AS s, data FROM oc_part),
pj AS (SELECT *, CASE WHEN json_valid(data) THEN json_type(data) = 'OBJECT' ELSE false END AS whole, CASE WHEN json_valid(data) THEN data END AS j FROM p),
spoken AS (SELECT message_id, bool_or(coalesce(json_extract_string(j, '$.type') = 'text' AND regexp_matches(json_extract_string(j, '$.text'), '[^\\s\\x0b\\x{85}\\p{Z}]'), false)) AS text FROM pj GROUP BY message_id),
mj AS (SELECT m.id, s, t, CASE WHEN json_valid(data) THEN json_type(data) = 'OBJECT' ELSE false END AS whole, nullif(lower(json_extract_string(CASE WHEN json_valid(data) THEN data END, '$.role')), '') AS role, coalesce(text, false) AS text FROM m LEFT JOIN spoken ON message_id = m.id),
bad AS (SELECT s FROM mj WHERE NOT whole OR role IS NULL OR (role = 'user' AND NOT text) UNION SELECT s FROM pj WHERE NOT whole AND s IS NOT NULL UNION SELECT s FROM mj WHERE s NOT IN (SELECT id FROM oc_session WHERE id IS NOT NULL)),
turn AS (SELECT s, id, role, row_number() OVER w AS n, lead(role) OVER w AS following FROM mj WHERE role IN ('user', 'assistant') AND text WINDOW w AS (PARTITION BY s ORDER BY t, id)),
good AS (SELECT s FROM turn GROUP BY s HAVING bool_and(n > 1 OR role = 'user') AND NOT bool_or(role = 'user' AND coalesce(following, 'user') = 'user'))"""
_BARE = "regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"

SQL = {
    "p3_found": "WITH " + _WINDOWS + " SELECT a AS note_a, b AS note_b FROM near",
    "p3_groups": "WITH RECURSIVE " + _WINDOWS + ", c AS (SELECT id, min(id) OVER (PARTITION BY f) AS rep, count(*) OVER (PARTITION BY f) AS n FROM t WHERE length(f) > 200), l AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM near JOIN c x ON a = x.id JOIN c y ON b = y.id WHERE x.rep <> y.rep), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT DISTINCT rep AS a, rep AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT id AS note_id, rep AS class_id, (SELECT min(b) FROM r WHERE r.a = rep) AS group_id, n AS n_copies, (SELECT count(*) FROM e WHERE e.a = rep) AS n_links FROM c",
    "p3_scores": "WITH " + _WINDOWS + " SELECT a AS note_a, b AS note_b, x.rel AS from_rel, y.rel AS to_rel, round(score, 6) AS score FROM near JOIN note_record x ON a = x.note_id JOIN note_record y ON b = y.note_id",
    "p5_found": "WITH " + _TURNS + " SELECT s AS session_id, n AS turn_no, id AS message_id FROM turn SEMI JOIN good USING (s) WHERE s NOT IN (SELECT s FROM bad)",
    "p5_texts": "WITH " + _TURNS + ", said AS (SELECT message_id, string_agg(x, chr(10) ORDER BY t NULLS FIRST, id, x) AS text FROM (SELECT DISTINCT id, message_id, time_created AS t, data, CASE WHEN json_valid(data) AND json_extract_string(data, '$.type') = 'text' THEN json_extract_string(data, '$.text') END AS x FROM oc_part) WHERE x IS NOT NULL GROUP BY message_id) SELECT s AS session_id, n AS turn_no, turn.id AS message_id, role, text FROM turn SEMI JOIN good USING (s) LEFT JOIN said ON message_id = turn.id WHERE s NOT IN (SELECT s FROM bad)",
    "p6_found": "SELECT chunk_id FROM chunk_note WHERE length(body) > 2000 AND is_parent_index IS DISTINCT FROM true",
    "p9_found": "WITH i AS (SELECT item_id, " + _BARE.format(x="passage") + " AS f FROM eval_item), g AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, length(f) - 38), lambda k: substr(f, k, 40))) AS x FROM i WHERE length(f) >= 40), d AS (SELECT doc_id, " + _BARE.format(x="text") + " AS f FROM documents), h AS (SELECT doc_id, unnest(list_transform(range(1, length(f) - 38), lambda k: substr(f, k, 40))) AS x FROM d WHERE length(f) >= 40) SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (x)",
}
