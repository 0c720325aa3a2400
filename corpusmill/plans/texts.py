"""Text measures and quality of notes, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import quality as Q
from corpusmill.plans import sqltext as S
from corpusmill.plans.relations import _COS, alike_notes
from corpusmill.sources.tables import table

AS_OF = "2026-01-01"
NEGATIONS = (r"不是|没有|不能|无法|并非|不得|不再", r"\b(?:not|never|no|cannot|without)\b")


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "note_record")


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated tokens of every document, with its characters."""
    return table(spark, folder, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"), F.char_length("text").cast("long").alias("chars"))


def tokenizer_variants(spark: SparkSession, folder: str) -> DataFrame:
    """How many tokens each of the four tokenizers gives a note."""
    b = F.col("body")
    return _notes(spark, folder).where("body is not null").select("note_id", *(F.size(f(b)).cast("long").alias(n) for n, f in (("index_tokens", X.tokens), ("unigrams", X.unigrams), ("runs", X.runs), ("pairs", X.char_pairs))))


def text_entropy(spark: SparkSession, folder: str) -> DataFrame:
    """Normalised character entropy of every note's body."""
    return _notes(spark, folder).where("body is not null").select("note_id", F.round(X.entropy(F.col("body")), 6).alias("entropy"))


def text_densities(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of signal characters, signal words, signal lines and negations of every body."""
    b = F.col("body")
    return _notes(spark, folder).where("body is not null").select(
        "note_id", F.round(X.signal_share(b), 6).alias("signal"), F.round(X.keyword_density(b, Q.ALL_SIGNALS), 6).alias("keywords"), F.round(X.line_share(b, Q.ALL_SIGNALS), 6).alias("lines"), F.round(X.pattern_density(b, *NEGATIONS), 6).alias("negations"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """SHA-256 of every body, and its key without case and marks."""
    return _notes(spark, folder).select("note_id", X.fingerprint(F.col("body")).alias("sha"), X.fingerprint(X.slot_key(F.col("title"))).alias("title_key"))


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies that stand more than once: the newest note of each, and how many there are. Texts never leave their rows; their hashes are grouped."""
    n = _notes(spark, folder).where("body is not null").select("note_id", "mtime", F.sha2(F.trim("body"), 256).alias("sha"))
    best = F.max_by("note_id", F.struct(F.col("mtime").isNotNull(), "mtime", -F.col("note_id")))
    return n.groupBy("sha").agg(F.count("*").alias("n"), best.alias("kept")).where("n > 1")


def wiki_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every link of a note to a target outside code."""
    return _notes(spark, folder).where("body is not null").select("note_id", F.explode(X.wiki_targets(F.col("body"))).alias("target")).groupBy("note_id", "target").agg(F.count("*").alias("n"))


def key_identifiers(spark: SparkSession, folder: str) -> DataFrame:
    """The identifiers of every note, distinct, at most forty."""
    return _notes(spark, folder).where("body is not null").select("note_id", F.posexplode(X.identifiers(F.col("body"))).alias("at", "identifier")).withColumn("at", F.col("at").cast("long"))


def boilerplate_share(spark: SparkSession, folder: str) -> DataFrame:
    """Share of filler and repeated lines of every chunk."""
    return table(spark, folder, "chunk_note").where("body is not null").select("chunk_id", F.round(Q.boilerplate(F.col("body")), 6).alias("share"))


def note_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The second-level sections of every note with the characters below their heading."""
    s = _notes(spark, folder).where("body is not null").select("note_id", F.posexplode(F.split("body", r"(?:^|\n)## ")).alias("at", "t")).where("at > 0")
    return s.select("note_id", F.col("at").cast("long").alias("section"), F.substring_index("t", "\n", 1).alias("heading"), (F.char_length("t") - F.char_length(F.substring_index("t", "\n", 1))).cast("long").alias("chars"))


def heading_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that a repair of doubled headings changes or that hold nothing but a placeholder."""
    c = table(spark, folder, "chunk_note").where("body is not null")
    return c.select("chunk_id", (X.heading_repaired(F.col("body")) != F.col("body")).alias("changed"), X.is_placeholder(F.col("body")).alias("placeholder"))


def tag_usage(spark: SparkSession, folder: str) -> DataFrame:
    """How many notes have each tag, compared in lower case without white space around."""
    t = _notes(spark, folder).select("note_id", F.explode(F.array_compact("tags")).alias("t")).select("note_id", F.lower(X.strip(F.col("t"))).alias("tag")).where("tag <> ''").distinct()
    return t.groupBy("tag").agg(F.count("*").alias("notes"))


def domain_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by first and second level of their domain; nulls and blanks as '-'."""
    d = F.coalesce(F.nullif(X.strip(F.col("domain")), F.lit("")), F.lit("-"))
    return _notes(spark, folder).select(F.split_part(d, F.lit("/"), F.lit(1)).alias("first"), F.split_part(d, F.lit("/"), F.lit(2)).alias("second")).groupBy("first", "second").agg(F.count("*").alias("notes"))


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Age in days on a fixed day, and whether a note is stale (older than 180) or of a status that may be found."""
    age = F.datediff(F.lit(AS_OF).cast("date"), F.coalesce("updated", "created"))
    status = F.coalesce(F.lower(F.trim("status")), F.lit(""))
    return _notes(spark, folder).select("note_id", age.cast("long").alias("age"), F.coalesce(age > 180, F.lit(False)).alias("stale"), status.isin("", "active", "stable", "legacy").alias("retrievable"))


def layers(spark: SparkSession, folder: str) -> DataFrame:
    """The layer of every chunk: index for parent indexes and pages of pointers only, else page."""
    lines = X.lines(F.coalesce("body", F.lit("")))
    pointer = F.filter(lines, lambda x: x.rlike(r"^(?:#{1,6}\s*\S{0,80}|[-*>]\s*\[\[[^\]]+\]\].*|\[\[[^\]]+\]\]|\|.*\||---+)$"))
    page = F.when(F.size(lines) == 0, True).when(F.size(lines) < 3, F.size(pointer) == F.size(lines)).otherwise(F.size(pointer) / F.size(lines) >= 0.6)
    return table(spark, folder, "chunk_note").select("chunk_id", F.when(F.coalesce("is_parent_index", F.lit(False)) | page, "index").otherwise("page").alias("layer"))


def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The gate's verdict on every note with its reasons."""
    g = _notes(spark, folder).select("note_id", Q.gate(F.col("body"), F.col("status"), F.col("source_tier")).alias("g"))
    return g.select("note_id", "g.verdict", F.array_join("g.hard", "; ").alias("hard"), F.array_join("g.soft", "; ").alias("soft"))


def content_types(spark: SparkSession, folder: str) -> DataFrame:
    """The content type of every note by its signal words."""
    return _notes(spark, folder).where("body is not null").select("note_id", Q.content_type(F.col("body")).alias("c")).select("note_id", "c.content_type", F.round("c.confidence", 2).alias("confidence"))


def ingest_quality(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every note's body on its way in."""
    return _notes(spark, folder).where("body is not null").select("note_id", Q.ingest_quality(F.col("body")).alias("kind"))


def triage_score(spark: SparkSession, folder: str) -> DataFrame:
    """The triage score of every note; its likeness to others is the largest tf-idf cosine, from 0.70 on."""
    required = [F.col(c) for c in ("title", "domain", "status", "author", "content_type", "kb_layer", "kb_summary", "created", "updated")]
    s = Q.triage_score(F.col("body"), required, F.col("similarity"), ["复盘", "方案", "原理", "决定", "because", "runbook"])
    p = alike_notes(spark, folder)
    best = p.select(F.explode(F.array("a", "b")).alias("note_id"), "cosine").groupBy("note_id").agg(F.round(F.max("cosine"), 7).alias("similarity"))
    return _notes(spark, folder).where("body is not null").join(best, "note_id", "left").select("note_id", s.cast("long").alias("score"))


def query_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Notes within all of a query's filters: domain (either level), importance, any tag, and dates compared as text."""
    d = F.lower(F.trim("domain"))
    tags = F.transform(F.coalesce(F.array_compact("tags"), F.array().cast("array<string>")), lambda t: F.lower(F.trim(t)))
    return _notes(spark, folder).where(
        ((d == "platform") | d.startswith("platform/") | (d == "retrieval") | d.startswith("retrieval/")) & (F.coalesce("importance", F.lit(0.0)) >= 0.2)
        & (F.arrays_overlap(tags, F.array(F.lit("ops/runbook"), F.lit("dev/refactoring"), F.lit("runbook"), F.lit("know/glossary"))) | F.col("content_type").isin("knowledge", "howto")) & (F.coalesce(F.col("updated").cast("string"), F.lit("")) >= "2022-01-01")).select("note_id")


def contract_check(spark: SparkSession, folder: str) -> DataFrame:
    """Fields of notes that break the contract: required ones missing, values outside their sets and ranges."""
    status, layer = F.lower(F.trim("status")), F.lower(F.trim("kb_layer"))
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin("", "null", "None")
    checks = [F.when(blank(c), f"{c}: missing") for c in ("title", "domain", "status", "created")] + [
        F.when(~blank("status") & ~status.isin("draft", "active", "stable", "legacy", "archived"), "status: unknown"), F.when(~blank("kb_layer") & ~layer.isin("canon", "page", "raw", "index", "noise"), "kb_layer: unknown"),
        F.when(~F.col("importance").between(0, 1), "importance: out of range"), F.when(~F.col("source_tier").between(1, 5), "source_tier: out of range"), F.when(F.col("updated") < F.col("created"), "updated: before created")]
    return _notes(spark, folder).select("note_id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


def field_usage(spark: SparkSession, folder: str) -> DataFrame:
    """In how many notes each field is filled, from one pass over the table."""
    cols = ["title", "domain", "status", "author", "content_type", "kb_layer", "kb_summary", "created", "updated", "importance", "source_tier", "body"]
    one = _notes(spark, folder).agg(*(F.count(F.col(c)).alias(c) for c in cols))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, cols)), F.array(*map(F.col, cols)))).alias("field", "notes"))


def report_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Notes by status, by layer and by both, in one pass by grouping sets."""
    n = _notes(spark, folder).select(F.coalesce(F.lower(F.trim("status")), F.lit("-")).alias("status"), F.coalesce(F.lower(F.trim("kb_layer")), F.lit("-")).alias("layer"))
    out = n.cube("status", "layer").agg(F.grouping_id().alias("g"), F.count("*").alias("notes")).where("g < 3")
    return out.select(F.coalesce("status", F.lit("*")).alias("status"), F.coalesce("layer", F.lit("*")).alias("layer"), "notes")


def source_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """How documents spread over their sources."""
    return Q.diversity(table(spark, folder, "documents"), "source")


def _confidence(spark: SparkSession, folder: str) -> DataFrame:
    c = Q.confidence(F.col("body"), F.lit(1), F.coalesce("updated", "created"), F.lit(AS_OF).cast("date"))
    return _notes(spark, folder).select("note_id", F.lower(F.trim("kb_layer")).alias("layer"), c.alias("confidence"))


def confidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Confidence of every note, and its tier: absolute, for the canon also against its own tenth and third percentile."""
    s = _confidence(spark, folder)
    canon = s.where("layer = 'canon'")
    cuts = Q.cutoff(canon, "confidence", 0.10).withColumnRenamed("cut", "p10").join(Q.cutoff(canon, "confidence", 0.03).withColumnRenamed("cut", "p3"), how="full", on=F.lit(True))
    t = s.join(cuts, how="left", on=F.col("layer") == "canon")
    tier = F.when(F.col("confidence") < F.col("p3"), "evidence-only").when(F.col("confidence") < F.col("p10"), "review").when(F.col("confidence") >= 0.55, "publish").when(F.col("confidence") >= 0.35, "review").otherwise("evidence-only")
    return t.select("note_id", "confidence", tier.alias("tier"))


def health_score(spark: SparkSession, folder: str) -> DataFrame:
    """One row of the collection's health: mean links, stale share, copies, and a score made of them."""
    n = _notes(spark, folder)
    age = F.datediff(F.lit(AS_OF).cast("date"), F.coalesce("updated", "created"))
    m = n.agg(F.count("*").alias("notes"), F.avg(F.coalesce(F.size(X.wiki_targets(F.col("body"))), F.lit(0)).cast("double")).alias("links"), F.avg(F.when(age > 180, 1.0).otherwise(0.0)).alias("stale"), F.countDistinct(F.sha2("body", 256)).alias("bodies"), F.count("body").alias("filled"))
    score = 100 - F.when(F.col("links") < 1.5, 20).otherwise(0) - F.when(F.col("stale") > 0.10, F.least(F.lit(30), F.floor(F.col("stale") * 100))).otherwise(0) - F.least(F.lit(10), F.col("filled") - F.col("bodies"))
    return m.select("notes", F.round("links", 6).alias("links"), F.round("stale", 6).alias("stale"), (F.col("filled") - F.col("bodies")).alias("copies"), F.greatest(F.lit(0), score).cast("long").alias("score"))


def evidence_grep(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of raw notes with a word, with the lines around them; the same three lines once."""
    n = _notes(spark, folder).where("lower(trim(kb_layer)) = 'raw' and body is not null").select("note_id", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    w = Window.partitionBy("note_id").orderBy("at")
    hits = n.select("note_id", "at", "line", F.lag("line").over(w).alias("before"), F.lead("line").over(w).alias("after")).where(F.contains(F.lower("line"), F.lit("checkpoint")))
    return hits.groupBy("line", "before", "after").agg(F.min("note_id").alias("note_id"), F.count("*").alias("n"))


def context_headers(spark: SparkSession, folder: str) -> DataFrame:
    """The header that stands before a note's text in the index: title, path, domain, tags and first line."""
    head = F.concat(F.lit("《"), F.coalesce("title", X.path_stem(F.col("rel"))), F.lit("》（"), F.concat_ws(" · ", "rel", "domain", F.nullif(F.array_join(F.array_compact("tags"), ","), F.lit(""))), F.lit("）"))
    return _notes(spark, folder).select("note_id", F.concat_ws("｜", head, X.first_line(F.col("body"))).alias("header"))


QUERIES = {f.__name__: f for f in (
    token_counts, tokenizer_variants, text_entropy, text_densities, fingerprints, exact_duplicates, wiki_links, key_identifiers, boilerplate_share, note_sections, heading_repair, tag_usage, domain_levels, freshness,
    layers, quality_gate, content_types, ingest_quality, triage_score, query_filters, contract_check, field_usage, report_counts, source_diversity, confidence_scores, health_score, evidence_grep, context_headers)}


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LINES = "list_filter(list_transform(string_split_regex({x}, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_L = _LINES.format(x="body")
_SOLID = "length(replace(replace(body, chr(10), ''), ' ', ''))"
_DENS = f"CASE WHEN {_SOLID} > 0 THEN coalesce(list_sum(list_transform(list_filter({_list(Q.ALL_SIGNALS)}, lambda w: contains(body, w)), lambda w: length(w))), 0) / {_SOLID} ELSE 0 END"
_ENT = "SELECT note_id, CASE WHEN count(*) <= 1 THEN 0.0 ELSE sum(-(k / n) * log2(k / n)) / log2(count(*)) END AS entropy FROM (SELECT note_id, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY note_id) AS n FROM (SELECT note_id, unnest(string_split(body, '')) AS c FROM note_record WHERE body IS NOT NULL) GROUP BY note_id, c) GROUP BY note_id"
_CHAT = "len(list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '\\[\\d{4}[-/]\\d{2}[-/]\\d{2}[^\\]]*\\]\\s*\\S+:\\s|\\d{1,2}:\\d{2}\\s+\\S+:\\s')))"


def _best(signals: dict[str, list[str]], fallback: str) -> str:
    rows = ", ".join(f"{{'n': len(list_filter({_list(w)}, lambda w: contains(body, w))), 'i': {-i}, 'k': '{k}'}}" for i, (k, w) in enumerate(signals.items()))
    return f"CASE WHEN list_max([{rows}]).n > 0 THEN {{'t': list_max([{rows}]).k, 'c': least(0.5 + 0.1 * list_max([{rows}]).n, 0.95)}} ELSE {{'t': '{fallback}', 'c': 0.5}} END"


_BLANK = "coalesce(trim(CAST({c} AS VARCHAR)), '') IN ('', 'null', 'None')"
_CONF = f"""conf AS (SELECT note_id, lower(trim(kb_layer)) AS layer, round(0.5e0 * ex + 0.25e0 * 0.35e0 + 0.15e0 * re + 0.04e0, 3) AS confidence FROM (
SELECT *, round(0.9e0 - 0.6e0 * least(coalesce(inferred / nullif(bullets, 0), 0), 0.5e0), 3) AS ex, CASE WHEN age IS NULL THEN 0.7e0 WHEN age <= 90 THEN 1e0 WHEN age >= 365 THEN 0.15e0 ELSE round(1 - 0.85e0 * (age - 90) / 275, 3) END AS re FROM (
SELECT *, len(list_filter({_LINES.format(x="coalesce(body, '')")}, lambda x: starts_with(x, '-'))) AS bullets, len(list_filter({_LINES.format(x="coalesce(body, '')")}, lambda x: starts_with(x, '-') AND contains(x, '^[推断]'))) AS inferred, date_diff('day', coalesce(updated, created), DATE '{AS_OF}') AS age FROM note_record)))"""
_KINDS = ["`([^`\\n]{2,60})`", "((?:/[\\w.-]+){2,})", "\\b(v?\\d+\\.\\d+(?:\\.\\d+)*)\\b", "\\b([\\w-]+(?:\\.[\\w-]+)*:\\d{2,5})\\b", "\\b(\\d+(?:\\.\\d+)?\\s?(?:ms|s|GB|MB|KB|%))", "\\b([\\w-]+\\.(?:py|md|json|yaml|yml|js|ts|sh|sql|csv|txt))\\b"]
_WITHOUT = "replace(" * len(Q.ANSWERS) + "w" + "".join(f", '{w}', '')" for w in Q.ANSWERS)
_PLAIN = "regexp_replace(regexp_replace(body, '(?s)```.*?(?:```|\\z)', '', 'g'), '`[^`\\n]*`', '', 'g')"
_TARGETS = f"list_filter(list_transform(regexp_extract_all({_PLAIN}, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(regexp_extract(x, '^[^#|]*'))), lambda x: x <> '')"
_PH = "(regexp_full_match({b}, '[\\s\\-_.·•*]*') OR regexp_full_match({b}, '(?i)(?:todo|tbd|待补|占位|placeholder|待补充|内容待补)[\\s\\-_.]*'))"
_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
STRIP = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"

SQL = {
    "token_counts": "SELECT doc_id, coalesce(length(regexp_replace(text, '[^一-鿿]', '', 'g')) + length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) // 4, 0) AS tokens, length(text) AS chars FROM documents",
    "tokenizer_variants": f"SELECT note_id, len({S.tokens('body')}) AS index_tokens, len(regexp_extract_all(body, '[A-Za-z0-9]+')) + len({S.han('body')}) AS unigrams, len(regexp_extract_all(body, '[A-Za-z0-9]+')) + len(regexp_extract_all(body, '[一-鿿]{{2,}}')) AS runs, greatest(length(regexp_replace(lower(trim(body, ' ')), '[\\s\\x0b]+', ' ', 'g')) - 1, 0) AS pairs FROM note_record WHERE body IS NOT NULL",
    "key_identifiers": "SELECT note_id, unnest(p) AS identifier, generate_subscripts(p, 1) - 1 AS at FROM (SELECT note_id, list_filter(l, lambda x, i: list_position(l, x) = i)[:40] AS p FROM (SELECT note_id, list_filter(list_transform(" + "list_concat(" * (len(_KINDS) - 1) + f"regexp_extract_all(body, '{_KINDS[0]}', 1), " + "), ".join(f"regexp_extract_all(body, '{k}', 1)" for k in _KINDS[1:]) + "), lambda x: trim(x)), lambda x: length(x) >= 2) AS l FROM note_record WHERE body IS NOT NULL))",
    "boilerplate_share": f"WITH l AS (SELECT chunk_id, unnest({_L}) AS x FROM chunk_note WHERE body IS NOT NULL), k AS (SELECT chunk_id, x, (trim(w) <> '' AND trim({_WITHOUT}) = '') OR {' OR '.join(f"starts_with(x, '{w}')" for w in Q.ANNOUNCES)} AS filler FROM (SELECT *, regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}} ]', '', 'g') AS w FROM l)), o AS (SELECT chunk_id, x, filler, NOT filler AND length(x) <= 40 AND count(*) FILTER (NOT filler) OVER (PARTITION BY chunk_id, x) >= 3 AS often FROM k), s AS (SELECT chunk_id, round(count(*) FILTER (filler OR often) / count(*), 6) AS share FROM o GROUP BY chunk_id) SELECT chunk_id, coalesce(share, 0) AS share FROM chunk_note LEFT JOIN s USING (chunk_id) WHERE body IS NOT NULL",
    "text_entropy": f"SELECT note_id, round(entropy, 6) AS entropy FROM ({_ENT})",
    "text_densities": f"SELECT note_id, round(length(regexp_replace(body, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / greatest(length(body), 1), 6) AS signal, round({_DENS}, 6) AS keywords, round(CASE WHEN len({_L}) > 0 THEN len(list_filter({_L}, lambda x: len(list_filter({_list(Q.ALL_SIGNALS)}, lambda w: contains(x, w))) > 0 OR regexp_matches(x, '^(?:\\$ |> |[-*] `|`)'))) / len({_L}) ELSE 0 END, 6) AS lines, round(CASE WHEN length(body) > 0 THEN (len(regexp_extract_all(body, '{NEGATIONS[0]}')) + len(regexp_extract_all(body, '{NEGATIONS[1]}'))) / length(body) ELSE 0 END, 6) AS negations FROM note_record WHERE body IS NOT NULL",
    "fingerprints": "SELECT note_id, sha256(body) AS sha, sha256(regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g')) AS title_key FROM note_record",
    "exact_duplicates": "SELECT sha, count(*) AS n, arg_max(note_id, (CASE WHEN mtime IS NULL THEN 0 ELSE 1 END, coalesce(mtime, TIMESTAMP '1970-01-01'), -note_id)) AS kept FROM (SELECT note_id, mtime, sha256(trim(body)) AS sha FROM note_record WHERE body IS NOT NULL) GROUP BY sha HAVING count(*) > 1",
    "wiki_links": f"SELECT note_id, target, count(*) AS n FROM (SELECT note_id, unnest({_TARGETS}) AS target FROM note_record) GROUP BY note_id, target",
    "note_sections": "SELECT note_id, i AS section, split_part(t, chr(10), 1) AS heading, length(t) - length(split_part(t, chr(10), 1)) AS chars FROM (SELECT note_id, unnest(p) AS t, generate_subscripts(p, 1) - 1 AS i FROM (SELECT note_id, string_split_regex(body, '(?:^|\\n)## ') AS p FROM note_record WHERE body IS NOT NULL)) WHERE i > 0",
    "heading_repair": f"SELECT chunk_id, regexp_replace(body, '(?m)^(#{{1,6}})[ \\t]+#{{1,6}}[ \\t]+(\\S.*)$', '\\1 \\2', 'g') <> body AS changed, {_PH.format(b=_TRIM.format(x='body'))} AS placeholder FROM chunk_note WHERE body IS NOT NULL",
    "tag_usage": f"SELECT tag, count(*) AS notes FROM (SELECT DISTINCT note_id, lower({STRIP.format(x='t')}) AS tag FROM (SELECT note_id, unnest({S.tags()}) AS t FROM note_record)) WHERE tag <> '' GROUP BY tag",
    "domain_levels": f"SELECT split_part(d, '/', 1) AS first, split_part(d, '/', 2) AS second, count(*) AS notes FROM (SELECT coalesce(nullif({STRIP.format(x='domain')}, ''), '-') AS d FROM note_record) GROUP BY 1, 2",
    "freshness": f"SELECT note_id, age, coalesce(age > 180, false) AS stale, coalesce(lower(trim(status)), '') IN ('', 'active', 'stable', 'legacy') AS retrievable FROM (SELECT *, date_diff('day', coalesce(updated, created), DATE '{AS_OF}') AS age FROM note_record)",
    "layers": f"SELECT chunk_id, CASE WHEN coalesce(is_parent_index, false) OR n = 0 OR (n < 3 AND p = n) OR (n >= 3 AND p / n >= 0.6) THEN 'index' ELSE 'page' END AS layer FROM (SELECT *, len(l) AS n, len(list_filter(l, lambda x: regexp_full_match(x, '(?:#{{1,6}}\\s*\\S{{0,80}}|[-*>]\\s*\\[\\[[^\\]]+\\]\\].*|\\[\\[[^\\]]+\\]\\]|\\|.*\\||---+)'))) AS p FROM (SELECT *, {_LINES.format(x='''coalesce(body, '')''')} AS l FROM chunk_note))",
    "quality_gate": f"""SELECT note_id, CASE WHEN len(hard) > 0 THEN 'reject' WHEN len(soft) > 0 THEN 'quarantine' ELSE 'pass' END AS verdict, coalesce(array_to_string(hard, '; '), '') AS hard, CASE WHEN len(hard) > 0 THEN '' ELSE coalesce(array_to_string(soft, '; '), '') END AS soft FROM (SELECT note_id,
list_filter([CASE WHEN length(t) < 15 THEN 'short' END, CASE WHEN {_PH.format(b='t')} THEN 'placeholder' END, CASE WHEN coalesce(trim(status), '') = '' THEN 'no status' END], lambda x: x IS NOT NULL) AS hard,
list_filter([CASE WHEN source_tier = 5 THEN 'tier 5' END, CASE WHEN len(l) > 0 AND (len(l) - len(list_distinct(l))) / len(l) > 0.4 THEN 'repeated lines' END, CASE WHEN length(s) > 0 AND length(regexp_replace(s, '[\\p{{L}}\\p{{N}}]', '', 'g')) / length(s) > 0.45 THEN 'marks' END, CASE WHEN len(list_filter(l, lambda x: length(x) > 1200)) > 0 THEN 'long line' END], lambda x: x IS NOT NULL) AS soft
FROM (SELECT *, {_TRIM.format(x='b')} AS t, regexp_replace(b, '\\s', '', 'g') AS s, {_LINES.format(x='b')} AS l FROM (SELECT *, coalesce(body, '') AS b FROM note_record)))""",
    "content_types": f"SELECT note_id, c.t AS content_type, round(c.c, 2) AS confidence FROM (SELECT note_id, CASE WHEN {_SOLID} < 15 THEN {{'t': 'noise', 'c': 1.0}} WHEN {_DENS} < 0.05 AND {_SOLID} < 200 THEN {{'t': 'noise', 'c': 0.9}} WHEN {_CHAT} >= 3 THEN {_best(Q.CHAT_SIGNALS, 'chat')} ELSE {_best(Q.SIGNALS, 'reference')} END AS c FROM note_record WHERE body IS NOT NULL)",
    "ingest_quality": f"SELECT n.note_id, CASE WHEN {_SOLID} < 15 THEN 'noise' WHEN {_DENS} < 0.05 AND {_SOLID} < 200 THEN 'noise' WHEN {_SOLID} < 200 AND len({_L}) > 0 AND (len(list_filter({_list(Q.CHAT_MARKERS)}, lambda w: contains(body, w))) > 0 OR (len(list_filter({_L}, lambda x: length(x) < 30)) > len({_L}) * 0.7 AND len({_L}) > 2)) THEN 'chat' WHEN {_DENS} >= 0.15 AND coalesce(entropy, 0) >= 0.7 THEN 'knowledge' ELSE 'reference' END AS kind FROM note_record n LEFT JOIN ({_ENT}) e USING (note_id) WHERE body IS NOT NULL",
    "triage_score": _COS + ", best AS (SELECT note_id, max(cosine) AS sim FROM (SELECT a AS note_id, cosine FROM cos WHERE cosine >= 0.70 UNION ALL SELECT b, cosine FROM cos WHERE cosine >= 0.70) GROUP BY note_id) SELECT note_id, 25 * (" + " + ".join(f"CASE WHEN trim(CAST({c} AS VARCHAR)) <> '' THEN 1 ELSE 0 END" for c in ("title", "domain", "status", "author", "content_type", "kb_layer", "kb_summary", "created", "updated")) + ") // 9 + CASE WHEN d >= 0.15 THEN 25 WHEN d >= 0.10 THEN 18 WHEN d >= 0.05 THEN 10 ELSE 3 END + CASE WHEN sim IS NULL THEN 25 WHEN round(sim, 7) >= 0.85 THEN 0 WHEN round(sim, 7) >= 0.70 THEN 10 ELSE 20 END + least(25, 5 + 3 * len(list_filter(['复盘', '方案', '原理', '决定', 'because', 'runbook'], lambda w: contains(body, w)))) AS score FROM (SELECT *, length(regexp_replace(body, '[^\\p{L}\\p{N}]', '', 'g')) / greatest(length(body), 1) AS d FROM note_record LEFT JOIN best USING (note_id) WHERE body IS NOT NULL)",
    "query_filters": f"SELECT note_id FROM note_record WHERE (lower(trim(domain)) IN ('platform', 'retrieval') OR starts_with(lower(trim(domain)), 'platform/') OR starts_with(lower(trim(domain)), 'retrieval/')) AND coalesce(importance, 0) >= 0.2 AND (list_has_any(list_transform(coalesce({S.tags()}, []), lambda t: lower(trim(t))), ['ops/runbook', 'dev/refactoring', 'runbook', 'know/glossary']) OR content_type IN ('knowledge', 'howto')) AND coalesce(CAST(updated AS VARCHAR), '') >= '2022-01-01'",
    "contract_check": "SELECT note_id, unnest(list_filter([" + ", ".join(f"CASE WHEN {_BLANK.format(c=c)} THEN '{c}: missing' END" for c in ("title", "domain", "status", "created")) + f", CASE WHEN NOT {_BLANK.format(c='status')} AND lower(trim(status)) NOT IN ('draft', 'active', 'stable', 'legacy', 'archived') THEN 'status: unknown' END, CASE WHEN NOT {_BLANK.format(c='kb_layer')} AND lower(trim(kb_layer)) NOT IN ('canon', 'page', 'raw', 'index', 'noise') THEN 'kb_layer: unknown' END, CASE WHEN importance NOT BETWEEN 0 AND 1 THEN 'importance: out of range' END, CASE WHEN source_tier NOT BETWEEN 1 AND 5 THEN 'source_tier: out of range' END, CASE WHEN updated < created THEN 'updated: before created' END], lambda x: x IS NOT NULL)) AS problem FROM note_record",
    "field_usage": " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS notes FROM note_record" for c in ("title", "domain", "status", "author", "content_type", "kb_layer", "kb_summary", "created", "updated", "importance", "source_tier", "body")),
    "report_counts": "SELECT coalesce(status, '*') AS status, coalesce(layer, '*') AS layer, count(*) AS notes FROM (SELECT coalesce(lower(trim(status)), '-') AS status, coalesce(lower(trim(kb_layer)), '-') AS layer FROM note_record) GROUP BY GROUPING SETS ((status), (layer), (status, layer))",
    "source_diversity": "SELECT count(*) AS groups, round(1 - sum(p * p), 6) AS simpson, round(-sum(p * ln(p)) / ln(count(*)), 6) AS shannon, round(max(p), 6) AS top_share FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM documents GROUP BY source)",
    "confidence_scores": f"WITH {_CONF}, ranked AS (SELECT confidence, row_number() OVER (ORDER BY confidence) AS r, count(*) OVER () AS n FROM conf WHERE layer = 'canon'), cuts AS (SELECT (SELECT max(confidence) FROM ranked WHERE r = greatest(1, CAST(floor(n * 0.10e0) AS BIGINT))) AS p10, (SELECT max(confidence) FROM ranked WHERE r = greatest(1, CAST(floor(n * 0.03e0) AS BIGINT))) AS p3) SELECT note_id, confidence, CASE WHEN layer = 'canon' AND confidence < p3 THEN 'evidence-only' WHEN layer = 'canon' AND confidence < p10 THEN 'review' WHEN confidence >= 0.55 THEN 'publish' WHEN confidence >= 0.35 THEN 'review' ELSE 'evidence-only' END AS tier FROM conf, cuts",
    "health_score": f"SELECT notes, round(links, 6) AS links, round(stale, 6) AS stale, copies, CAST(greatest(0, 100 - CASE WHEN links < 1.5 THEN 20 ELSE 0 END - CASE WHEN stale > 0.10 THEN least(30, floor(stale * 100)) ELSE 0 END - least(10, copies)) AS BIGINT) AS score FROM (SELECT count(*) AS notes, avg(coalesce(len({_TARGETS}), 0)) AS links, avg(CASE WHEN date_diff('day', coalesce(updated, created), DATE '{AS_OF}') > 180 THEN 1.0 ELSE 0 END) AS stale, count(body) - count(DISTINCT body) AS copies FROM note_record)",
    "evidence_grep": "SELECT line, before, after, min(note_id) AS note_id, count(*) AS n FROM (SELECT note_id, line, lag(line) OVER w AS before, lead(line) OVER w AS after FROM (SELECT note_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT note_id, string_split(body, chr(10)) AS l FROM note_record WHERE lower(trim(kb_layer)) = 'raw' AND body IS NOT NULL)) WINDOW w AS (PARTITION BY note_id ORDER BY i)) WHERE contains(lower(line), 'checkpoint') GROUP BY line, before, after",
    "context_headers": f"SELECT note_id, concat_ws('｜', '《' || coalesce(title, regexp_replace(regexp_replace(replace(rel, '\\', '/'), '^.*/', '', 's'), '\\.[A-Za-z0-9]{{1,5}}$', '')) || '》（' || concat_ws(' · ', rel, domain, nullif(array_to_string({S.tags()}, ','), '')) || '）', substring(list_filter({_L}, lambda x: NOT starts_with(x, '#'))[1], 1, 120)) AS header FROM note_record",
}
