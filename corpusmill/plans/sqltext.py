"""Pieces of SQL that queries share."""

from __future__ import annotations


def han(x: str) -> str:
    return f"list_filter(string_split(regexp_replace({x}, '[^一-鿿]', '', 'g'), ''), lambda c: c <> '')"


def tokens(x: str) -> str:
    """The index tokens of a text."""
    flat = f"regexp_replace({x}, '[^一-鿿]', '', 'g')"
    pairs = f"list_transform(list_zip(string_split({flat}, ''), string_split(substr({flat}, 2), ''), true), lambda z: z[1] || z[2])"
    return f"list_concat(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda w: lower(w)), {han(x)}, CASE WHEN length({flat}) > 1 THEN {pairs} ELSE [] END)"


def tags(x: str = "tags") -> str:
    return f"list_filter({x}, lambda t: t IS NOT NULL)"


NOTE_TEXT = f"concat_ws(' ', title, body, array_to_string({tags()}, ' '))"


def indexed(table: str = "note_record", doc: str = "note_id", text: str = NOTE_TEXT) -> str:
    """Common table expressions of an index: texts, postings, stats, terms, docs."""
    return f"""texts AS (SELECT {doc} AS doc, {text} AS txt FROM {table}),
toks AS (SELECT doc, unnest({tokens('txt')}) AS term FROM texts WHERE txt IS NOT NULL),
postings AS (SELECT doc, term, count(*) AS tf FROM toks GROUP BY doc, term),
nn AS (SELECT count(*) AS n FROM texts),
terms AS (SELECT term, count(*) AS df, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM postings, nn GROUP BY term, n),
weights AS (SELECT doc, sum(tf) AS dl, sqrt(sum(pow(tf * idf, 2))) AS norm FROM postings JOIN terms USING (term) GROUP BY doc),
docs AS (SELECT doc, coalesce(dl, 0) AS dl, coalesce(norm, 1.0) AS norm FROM texts LEFT JOIN weights USING (doc)),
stats AS (SELECT n, (SELECT sum(dl) FROM docs) / n AS avgdl FROM nn)"""


def asked(table: str = "canon_term", query: str = "term_id", text: str = "term", where: str = "true") -> str:
    """Query terms, cosine and BM25 scores on top of ``indexed``."""
    return f"""q AS (SELECT query, term, count(*) AS qtf FROM (SELECT {query} AS query, unnest({tokens(text)}) AS term FROM {table} WHERE {where}) GROUP BY query, term),
qw AS (SELECT query, term, idf, qtf * idf AS w FROM q JOIN terms USING (term)),
qn AS (SELECT query, sqrt(sum(w * w)) AS qnorm FROM qw GROUP BY query),
cosine AS (SELECT query, doc, dot / qnorm / norm AS score FROM (SELECT query, doc, sum(tf * idf * w) AS dot FROM postings JOIN qw USING (term) GROUP BY query, doc) JOIN qn USING (query) JOIN docs USING (doc)),
bm25 AS (SELECT query, doc, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e-9)))) AS score
 FROM postings JOIN q USING (term) JOIN terms USING (term) JOIN docs USING (doc), stats GROUP BY query, doc)"""


def top(scores: str, k: int, digits: int = 9) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, {digits}) DESC, doc) AS rank FROM {scores} QUALIFY rank <= {k})"


RRF = f"""fused AS (SELECT query, doc, sum(1 / (rank + 60)) AS score FROM (SELECT query, doc, rank FROM {top('cosine', 300)} UNION ALL SELECT query, doc, rank FROM {top('bm25', 300)}) GROUP BY query, doc)"""

FIELDS = f"""fieldvals AS (SELECT note_id AS doc, unnest(list_concat(coalesce({tags()}, []), coalesce({tokens('kb_summary')}, []))) AS value FROM note_record),
matches AS (SELECT query, doc, sum(qtf) AS n FROM fieldvals JOIN q ON value = term GROUP BY query, doc),
boosted AS (SELECT query, doc, sum(score) AS score FROM (SELECT query, doc, score FROM fused UNION ALL SELECT query, doc, n * 0.15 FROM matches) GROUP BY query, doc)"""

LAYER = "CASE lower(trim(kb_layer)) WHEN 'canon' THEN 1.25 WHEN 'raw' THEN 0.72 WHEN 'index' THEN 0.6 WHEN 'noise' THEN 0.6 ELSE 1.0 END"
PRIORITY = "CASE WHEN content_type = 'policy' THEN 1.05 WHEN content_type = 'reference' THEN 0.95 WHEN content_type IN ('chat', 'chat_decision', 'chat_knowledge', 'chat_todo') THEN 0.9 ELSE 1.0 END"
