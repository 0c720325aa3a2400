"""Readers: notes, web pages, mail, JSON, tables and chat exports as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def vault(spark: SparkSession, root: str, skip: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """``rel, text, mtime`` of every Markdown file below ``root``, outside directories named in ``skip``; bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace(F.col("path"), "^(?:file:)?/*", "/")
    rel = F.when(rel.startswith(base + "/"), F.substring(rel, len(base) + 2, 1 << 30)).otherwise(rel)
    out = files.select(rel.alias("rel"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("modificationTime").alias("mtime"))
    return out.where(~F.exists(F.split("rel", "/"), lambda p: p.isin(*skip)))


def frontmatter(text: Column) -> Column:
    """``fm`` (map of strings) and ``body`` of a note: ``key: value`` lines between the first two lines ``---``.

    Values lose their quotes; ``key:`` alone has a null value; a line without a
    colon or after ``#`` is left out; the last of equal keys counts. Without two
    such lines the map is empty and the body is the text.
    """
    flat = F.regexp_replace(text, r"\r\n?", "\n")
    block = F.regexp_extract(flat, r"(?s)\A(?:.*?\n)??---[ \t]*\n(.*?)(?:\n|(?<=\n))---[ \t]*(?:\n|\z)", 1)
    has = flat.rlike(r"(?s)\A(?:.*?\n)??---[ \t]*\n.*?(?:(?<=\n))---[ \t]*(?:\n|\z)")
    body = F.regexp_replace(flat, r"(?s)\A(?:.*?\n)??---[ \t]*\n.*?(?<=\n)---[ \t]*(?:\n|\z)", "")
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit(":")) & ~x.startswith("#"))
    key = lambda x: F.trim(F.substring_index(x, ":", 1))
    value = lambda x: F.nullif(F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']+|[\"']+$", ""), F.lit(""))
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("k"), F.when(x.endswith(":"), F.lit(None)).otherwise(value(x)).alias("v")))
    # of equal keys the last: those that no later one repeats
    keys = F.transform(pairs, lambda p: p["k"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
    return F.struct(F.when(has, F.map_from_entries(last)).otherwise(F.create_map().cast("map<string,string>")).alias("fm"), F.when(has, body).otherwise(flat).alias("body"))


def list_field(value: Column) -> Column:
    """A field ``[a, "b, c"]`` as an array: commas within quotes don't part; a value without brackets is one element, null none."""
    inner = F.regexp_extract(value, r"^\s*\[(.*)\]\s*$", 1)
    parts = F.regexp_extract_all(inner, F.lit(r"""((?:"[^"]*"|'[^']*'|[^,"'])+)"""), F.lit(1))
    clean = F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")), lambda x: x != "")
    return F.when(value.rlike(r"^\s*\[.*\]\s*$"), clean).when(F.trim(value) != "", F.array(F.trim(value))).otherwise(F.array().cast("array<string>"))


# What a page shows no text of, what ends a line, and what characters names stand for; the ampersand last.
HIDDEN = ("script", "style", "noscript", "head", "header", "footer", "nav")
BREAKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6")
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "mdash": "—", "ndash": "–", "hellip": "…", "middot": "·", "copy": "©", "amp": "&"}


def html_text(html: Column) -> Column:
    """The text of a page: without comments and ``HIDDEN`` elements, ``BREAKS`` as line ends, other tags as blanks, ``ENTITIES`` as characters; no two empty lines in a row."""
    shown = F.regexp_replace(html, rf"(?is)<!--.*?-->|<({'|'.join(HIDDEN)})(?=[\s>/]).*?</\1\s*>", " ")
    marked = F.regexp_replace(shown, rf"(?i)</?(?:{'|'.join(BREAKS)})(?=[\s>/])[^<>]*>", "\n")
    text = F.regexp_replace(marked, r"</?[A-Za-z!][^<>]*>", " ")
    for name, character in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
    lines = F.transform(F.split(text, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\r\xa0]+", " ")))
    # an empty line stays where the one before it isn't empty
    kept = F.filter(lines, lambda x, i: (x != "") | (F.get(lines, i - 1) != ""))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \n"))


def html_title(html: Column) -> Column:
    """The page's title, at most 120 characters; null without one."""
    return F.nullif(F.substring(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"<[^>]+>", "")), 1, 120), F.lit(""))


def mails(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` (``content`` binary) with ``sender, subject, date, text``: the first plain part, else the first HTML part; nulls for what is no mail."""

    def run(batches: Iterator) -> Iterator:
        import email
        from email import policy

        import pyarrow as pa

        def read(blob: bytes | None) -> tuple:
            try:
                m = email.message_from_bytes(blob, policy=policy.default)
                part = m.get_body(("plain", "html"))
                return (*(None if m[h] is None else str(m[h]) for h in ("From", "Subject", "Date")), None if part is None else part.get_content())
            except Exception:  # noqa: BLE001 - whatever a broken mail does to the parser, its row stays
                return (None,) * 4

        for batch in batches:
            rows = [read(x) for x in batch.column(batch.schema.get_field_index(content)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], pa.string()) for i in range(4))], names=[*batch.schema.names, "sender", "subject", "date", "text"])

    rows = files.drop("sender", "subject", "date", "text")
    schema = T.StructType(rows.schema.fields + [T.StructField(n, T.StringType()) for n in ("sender", "subject", "date", "text")])
    return rows.mapInArrow(run, schema)


def json_kind(data: Column) -> Column:
    """records, threads, nested_array or generic; null for what is no JSON."""
    keys = F.json_object_keys(data)
    array = F.get_json_object(data, "$[0]").isNotNull() | data.rlike(r"^\s*\[")
    nested = F.exists(F.transform(keys, lambda k: F.from_json(data, "map<string,string>")[k]), lambda v: v.rlike(r"^\s*\["))
    return F.when(F.try_parse_json(data).isNull(), F.lit(None)).when(F.get_json_object(data, "$.tables.records").isNotNull(), "records").when(F.array_contains(keys, "thread_items"), "threads").when(array | F.coalesce(nested, F.lit(False)), "nested_array").otherwise("generic")


def json_leaves(rows: DataFrame, data: str, depth: int = 6) -> DataFrame:
    """``rows`` with ``path, value``: every leaf of the JSON in ``data``, by key names and places; nothing for what is no JSON. Levels below ``depth`` are values as JSON."""
    level = rows.withColumn("_v", F.try_parse_json(data)).where(F.col("_v").isNotNull()).withColumn("path", F.lit(""))
    out = None
    names = [c for c in rows.columns if c not in ("path", "value")]
    for d in range(depth):
        kind = F.schema_of_variant("_v")
        deep = kind.startswith("OBJECT") | kind.startswith("ARRAY") if d < depth - 1 else F.lit(False)
        leaf = level.where(~deep).select(*names, F.substring("path", 2, 1 << 30).alias("path"), F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json("_v")).otherwise(F.try_variant_get("_v", "$", "string")).alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        if d < depth - 1:
            inner = rows.sparkSession.tvf.variant_explode(F.col("_v").outer()).select("pos", "key", F.col("value").alias("_w"))
            level = level.where(deep).lateralJoin(inner).select(*names, F.concat("path", F.lit("."), F.coalesce("key", F.col("pos").cast("string"))).alias("path"), F.col("_w").alias("_v"))
    return out


def csv_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A table with its first row as names, read as text; short rows are filled with nulls."""
    return spark.read.csv(path, header=True, sep=sep, mode="PERMISSIVE")


def rendered(table: DataFrame) -> DataFrame:
    """``line``: each row as a Markdown table row; nulls as empty cells."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]
    return table.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def parsed_time(value: Column) -> Column:
    """A timestamp (session zone) of the forms that chats export: date and time with - or /, ISO with or without a zone, a day of eight digits, epoch milliseconds or seconds with a fraction; null for others."""
    v = F.trim(value)
    forms = ("yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
    number = v.try_cast("double")
    epoch = F.when(number >= 1e11, F.timestamp_millis(number.cast("long"))).when(number >= 1e8, F.timestamp_micros((number * 1e6).cast("long")))
    return F.coalesce(*(F.try_to_timestamp(v, F.lit(f)) for f in forms), F.when(v.rlike(r"^\d+(\.\d+)?$"), epoch))


def chat_csv(lines: DataFrame, line: str = "value") -> DataFrame:
    """``ts, sender, content, thread_ts`` of lines ``time,person,message``; lines without a time are left out, commas in messages stay."""
    p = lambda k: F.trim(F.regexp_extract(line, r"^([^,]*),([^,]*),(.*)$", k))
    return lines.select(parsed_time(p(1)).alias("ts"), p(2).alias("sender"), F.regexp_replace(p(3), '^"|"$', "").alias("content"), F.lit(None).cast("string").alias("thread_ts")).where("ts is not null")


def chat_json(items: DataFrame, item: str = "value") -> DataFrame:
    """The same of JSON messages under any of the names that platforms use; those without a time are left out."""
    first = lambda *names: F.coalesce(*(F.get_json_object(item, f"$.{n}") for n in names))
    return items.select(
        parsed_time(first("time", "timestamp", "sendTime", "create_time", "msg_time", "ts", "datetime")).alias("ts"), F.coalesce(first("sender", "from", "senderNick", "sender_id", "user_id", "user", "username"), F.lit("")).alias("sender"),
        F.coalesce(first("content", "text", "message", "body"), F.lit("")).alias("content"), first("thread_ts").alias("thread_ts")).where("ts is not null")


def chat_items(exports: DataFrame, data: str = "value") -> DataFrame:
    """``value``: the messages of exports that are an array, or an object with one under ``messages``, ``data``, ``items`` or ``records``, each as JSON; nothing for others."""
    under = F.coalesce(*(F.get_json_object(data, f"$.{k}") for k in ("messages", "data", "items", "records")))
    array = F.when(F.ltrim(F.col(data)).startswith("["), F.col(data)).otherwise(under)
    return exports.select(F.explode(F.from_json(array, "array<string>")).alias("value")).where("value is not null")


def chat_text(lines: DataFrame, line: str = "value") -> DataFrame:
    """The same of lines ``[time] who: text``; other lines are left out."""
    told = lines.where(F.startswith(line, F.lit("[")) & F.contains(line, F.lit("]"))).select(F.substring_index(F.substring(line, 2, 1 << 30), "]", 1).alias("at"), F.expr(f"trim(substr({line}, instr({line}, ']') + 1))").alias("said"))
    told = told.where(F.instr("said", ":") > 1).select(parsed_time(F.col("at")).alias("ts"), F.trim(F.substring_index("said", ":", 1)).alias("sender"), F.expr("trim(substr(said, instr(said, ':') + 1))").alias("content"), F.lit(None).cast("string").alias("thread_ts"))
    return told.where("ts is not null")


def thread_turns(items: DataFrame) -> DataFrame:
    """``thread_id, turn_id, user, reply, reasoning, ts`` of rows ``thread_id, turn_id, item_type, item_json, created_at_ms``: of each kind the latest, cut to 300, 400 and 200 characters.

    A turn without a user message or reasoning has no row; what is no JSON is left out.
    """
    joined = F.array_join(F.transform(F.from_json(F.get_json_object("item_json", "$.content"), "array<struct<text:string>>"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    plain = F.array_join(F.from_json(F.get_json_object("item_json", "$.content"), "array<string>"), "")
    r = items.where(F.try_parse_json("item_json").isNotNull()).select("thread_id", "turn_id", "item_type", "created_at_ms", F.trim(joined).alias("user"), F.trim(F.get_json_object("item_json", "$.text")).alias("reply"), F.trim(plain).alias("thought"))
    last = lambda kind, value: F.max_by(F.when(F.col("item_type") == kind, F.col(value)), F.when((F.col("item_type") == kind) & (F.coalesce(F.col(value), F.lit("")) != ""), F.col("created_at_ms")))
    out = r.groupBy("thread_id", "turn_id").agg(F.substring(last("userMessage", "user"), 1, 300).alias("user"), F.substring(last("agentMessage", "reply"), 1, 400).alias("reply"), F.substring(last("reasoning", "thought"), 1, 200).alias("reasoning"), F.min("created_at_ms").alias("ts"))
    return out.where("user is not null or reasoning is not null").select("thread_id", "turn_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("user", "reply", "reasoning")), "ts")


def memory_records(rows: DataFrame, data: str = "value") -> DataFrame:
    """``id, title, content, kind, importance, day`` of documents ``{"tables": {"records": {id: {...}}}}``; records without content are left out."""
    records = F.from_json(F.get_json_object(data, "$.tables.records"), "map<string,struct<content:string,kind:string,importance:string,createdAt:string,updatedAt:string>>")
    r = rows.select(F.explode(records).alias("id", "r")).select("id", "r.*").where("trim(content) <> ''")
    title = F.trim(F.regexp_extract("content", r"^([^：\n]*)", 1))
    return r.select("id", F.when(F.char_length(title) < 4, F.substring(F.coalesce("kind", F.lit("fact")), 1, 6)).otherwise(title).alias("title"), F.trim("content").alias("content"), "kind", F.col("importance").try_cast("double").alias("importance"), F.substring(F.coalesce("updatedAt", "createdAt"), 1, 10).alias("day"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ledger of JSON lines; broken lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")
