"""Records that differ only in formatting.

Each column is dictionary-encoded: every distinct value is canonicalised once
and its fields get integer identifiers. A record becomes the sorted tuple of
the identifiers of its fields, and copies are records with equal tuples.

The identifier of a field is its 128-bit fingerprint as two bigints: the same
in every task and after every retry, so that no table of identifiers has to be
numbered, kept or looked up. Texts are shuffled once, for the distinct values;
everything after moves only tuples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut

#: A line ``key: value``: a list mark, a key of at most 30 characters, a colon, a value.
CARD_LINE = r"^\s*(?:[-*+•·]\s+)?(?=[^\s:：])([^:：\n]{1,30}?)\s*[:：]\s*\S"
CARD_KEY = r"^\s*(?:[-*+•·]\s+)?([^:：\n]{1,30}?)\s*[:：]"


def bare(text: Column) -> Column:
    """Letters and digits of ``text`` in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def fingerprint(*parts: Column) -> Column:
    """128 bits of ``parts`` as a struct of two bigints."""
    return F.struct(F.xxhash64(F.lit(7), *parts).alias("a"), F.xxhash64(F.lit(11), *parts, F.lit(13)).alias("b"))


def fields(body: Column) -> Column:
    """The fields of a body as bare strings, each with its key, or one string for a body without fields.

    A JSON object and a text of two or more non-blank ``key: value`` lines have
    fields; a nested value counts as its text. Fields keep repeats.
    """
    lines = F.filter(F.split(body, r"\r\n|\r|\n"), lambda x: x.rlike(r"\S"))
    is_card = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.rlike(CARD_LINE))
    card = F.transform(lines, lambda x: F.concat_ws("\u0001", bare(F.regexp_extract(x, CARD_KEY, 1)), bare(F.regexp_replace(x, CARD_KEY, ""))))
    parsed = F.when(body.rlike(r"^\s*\{[\s\S]*\}\s*$"), F.from_json(body, "map<string,string>"))
    json = F.transform(F.map_entries(parsed), lambda e: F.concat_ws("\u0001", bare(e["key"]), bare(e["value"])))
    return F.when(parsed.isNotNull() & (F.size(parsed) > 0), json).when(is_card, card).otherwise(F.array(bare(body)))


def encoded(records: DataFrame, record_id: str, columns: list[str], structured: list[str]) -> DataFrame:
    """``record_id, t``: each record as its tuple, null where a column of ``structured`` has no letter or digit."""
    rows = records.select(F.col(record_id).alias("_id"), *(F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(columns)))
    for i, c in enumerate(columns):
        raw = F.col("_v")
        distinct = rows.select(F.coalesce(F.col(f"_c{i}"), F.lit("")).alias("_v")).distinct()
        ids = F.transform(fields(raw) if c in structured else F.array(bare(raw)), lambda x: fingerprint(x))
        dictionary = distinct.select(
            fingerprint(raw).alias("_k"), F.when(F.lit(c not in structured) | raw.rlike(r"[\p{L}\p{N}]"), F.sort_array(ids)).alias(f"_t{i}")
        )
        rows = rows.withColumn(f"_c{i}", fingerprint(F.coalesce(F.col(f"_c{i}"), F.lit("")))).alias("r")
        rows = rows.join(dictionary.alias("d"), F.col(f"r._c{i}") == F.col("d._k")).drop("_k", f"_c{i}")
    whole = F.array(*(F.col(f"_t{i}") for i in range(len(columns))))
    missing = F.exists(whole, lambda t: t.isNull())
    # with the sizes, as hashes of arrays don't tell where one ends
    parts = [p for i in range(len(columns)) for p in (F.size(f"_t{i}"), F.col(f"_t{i}"))]
    return rows.select("_id", F.when(~missing, fingerprint(*parts)).alias("t"))


def format_copies(records: DataFrame, record_id: str = "note_id", columns: tuple = ("rel", "body"), structured: tuple = ("body",)) -> DataFrame:
    """``record_id, first_id, n_copies`` of every record: its group's smallest id and its group's size.

    Records are copies when every column of ``columns`` agrees after letter case
    and all characters but letters and digits are left out; a column of
    ``structured`` that is a JSON object or ``key: value`` lines counts as its
    fields in any order. A record whose structured column is null or has no
    letter or digit is a group by itself. A null elsewhere counts as empty.

    A record id that is repeated counts once. An empty table gives no rows;
    columns not named are not read, whatever their names.

    A hot group costs one row a map task in the aggregate; the join that brings
    its first id back streams over it and may be split where it is skewed.
    """
    # used twice: written to the shared folder, so that the texts are shuffled and canonicalised once
    tuples = cut(encoded(records, record_id, list(columns), list(structured)).distinct())
    groups = tuples.where("t is not null").groupBy("t").agg(F.min("_id").alias("first_id"), F.count("*").alias("n_copies"))
    groups = groups.where("n_copies > 1")
    # records without a tuple take no part in the join: they would all be one key
    of, one = F.col("_id").alias(record_id), F.lit(1).cast("long")
    joined = tuples.where("t is not null").join(groups, "t", "left").select(of, F.coalesce("first_id", "_id").alias("first_id"), F.coalesce("n_copies", one).alias("n_copies"))
    return joined.unionByName(tuples.where("t is null").select(of, F.col("_id").alias("first_id"), one.alias("n_copies")))
