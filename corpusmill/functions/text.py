"""Text functions as columns. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HAN = "[一-鿿]"
NOT_HAN = "[^一-鿿]"


def latin(s: Column) -> Column:
    """Runs of ASCII letters and digits, in order, as they are."""
    return F.regexp_extract_all(s, F.lit("[A-Za-z0-9]+"), F.lit(0))


def low_latin(s: Column) -> Column:
    """The same in lower case. Letters are translated one by one: a whole text's lower case may gain ASCII letters from others."""
    return F.regexp_extract_all(F.translate(s, string.ascii_uppercase, string.ascii_lowercase), F.lit("[a-z0-9]+"), F.lit(0))


def han(s: Column) -> Column:
    """Han characters, in order."""
    return F.regexp_extract_all(s, F.lit(HAN), F.lit(0))


def tokens(s: Column) -> Column:
    """Index tokens: lower-case Latin runs, then each Han character and each pair of neighbours among them.

    Pairs reach across whatever stood between the two characters. An empty text gives an empty array.
    """
    flat = F.regexp_replace(s, NOT_HAN, "")
    each, pairs = F.regexp_extract_all(flat, F.lit("."), F.lit(0)), F.regexp_extract_all(flat, F.lit("(?=(..))"), F.lit(1))
    return F.concat(low_latin(s), F.flatten(F.zip_with(each, pairs, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b)))))


def unigrams(s: Column) -> Column:
    """Lower-case Latin runs, then Han characters one by one."""
    return F.concat(low_latin(s), han(s))


def runs(s: Column) -> Column:
    """Lower-case Latin runs and runs of two or more Han characters, in order of kind."""
    return F.concat(low_latin(s), F.regexp_extract_all(s, F.lit(HAN + "{2,}"), F.lit(0)))


def han_first(s: Column) -> Column:
    """Han characters one by one, then Latin runs in their own case."""
    return F.concat(han(s), latin(s))


def _windows(flat: Column, k: int) -> Column:
    """Every window of ``k`` characters, in order; shorter texts have none. Arrays are zipped, so the work is linear in the text."""
    chars = F.filter(F.split(flat, ""), lambda c: c != "")
    out = chars
    for i in range(1, k):
        out = F.zip_with(out, F.slice(chars, i + 1, 1 << 30), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, b)))
    return F.filter(out, lambda x: x.isNotNull())


def char_pairs(s: Column) -> Column:
    """Pairs of neighbouring characters of the lower-case text, runs of white space as one blank."""
    return _windows(F.regexp_replace(F.lower(F.trim(s)), r"\s+", " "), 2)


def shingles(s: Column, k: int = 5) -> Column:
    """Distinct windows of ``k`` characters of the text without white space; the whole text where it is shorter, none where it is empty."""
    flat = F.regexp_replace(s, r"\s+", "")
    n = F.char_length(flat)
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= k, F.array(flat)).otherwise(F.array_distinct(_windows(flat, k)))


def strip(s: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def token_count(s: Column) -> Column:
    """Estimated model tokens: one a Han character, one for four characters of Latin runs. 0 for null."""
    letters = F.char_length(F.regexp_replace(s, "[^A-Za-z0-9]", ""))
    return F.coalesce(F.char_length(F.regexp_replace(s, NOT_HAN, "")) + F.floor(letters / 4), F.lit(0)).cast("long")


def fingerprint(s: Column) -> Column:
    """SHA-256 of the text's UTF-8 bytes, in hexadecimal."""
    return F.sha2(s, 256)


def signal_share(s: Column) -> Column:
    """Letters and digits by all characters; 0 for an empty text."""
    return F.char_length(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")) / F.greatest(F.char_length(s), F.lit(1))


def solid_length(s: Column) -> Column:
    """Characters that are neither blanks nor line feeds."""
    return F.char_length(F.translate(s, "\n ", ""))


def present(s: Column, words: list[str], count: bool = True) -> Column:
    """How many of ``words`` the text contains, or, without ``count``, their characters together."""
    return sum((F.when(F.contains(s, F.lit(w)), 1 if count else len(w)).otherwise(0) for w in words[1:]), F.when(F.contains(s, F.lit(words[0])), 1 if count else len(words[0])).otherwise(0))


def keyword_density(s: Column, words: list[str]) -> Column:
    """Summed lengths of the distinct words present by ``solid_length``; 0 where nothing is solid."""
    n = solid_length(s)
    return F.when(n > 0, present(s, sorted(set(words)), count=False) / n).otherwise(F.lit(0.0))


def lines(s: Column) -> Column:
    """Lines that aren't blank, trimmed."""
    return F.filter(F.transform(F.split(s, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def line_share(s: Column, words: list[str]) -> Column:
    """Lines with one of ``words`` or a command at their start, by all lines that aren't blank; 0 without lines."""
    each = lines(s)
    hit = F.filter(each, lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)) | x.rlike(r"^(?:\$ |> |[-*] `|`)"))
    return F.when(F.size(each) > 0, F.size(hit) / F.size(each)).otherwise(F.lit(0.0))


def pattern_density(s: Column, *patterns: str) -> Column:
    """Matches of all ``patterns`` by characters; 0 for an empty text."""
    found = sum((F.regexp_count(s, F.lit(p)) for p in patterns[1:]), F.regexp_count(s, F.lit(patterns[0])))
    return F.when(F.char_length(s) > 0, found / F.char_length(s)).otherwise(F.lit(0.0))


def slot_key(s: Column) -> Column:
    """The text in lower case without anything but letters and digits: equal for questions put alike."""
    return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]", "")


def wiki_targets(s: Column) -> Column:
    """Targets of ``[[target#anchor|alias]]`` links outside code, trimmed, in order; blank targets are left out."""
    plain = F.regexp_replace(F.regexp_replace(s, "(?s)```.*?(?:```|$)", ""), "`[^`\n]*`", "")
    return F.filter(F.transform(F.regexp_extract_all(plain, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: F.trim(F.regexp_extract(x, r"^[^#|]*", 0))), lambda x: x != "")


def path_stem(rel: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(F.regexp_replace(rel, r"\\", "/"), "/"), -1), r"\.[A-Za-z0-9]{1,5}$", "")


def identifiers(s: Column, cap: int = 40) -> Column:
    """Distinct identifiers in order of kind: code spans, paths, versions, hosts with ports, quantities and file names; the first ``cap``."""
    kinds = (r"`([^`\n]{2,60})`", r"((?:/[\w.-]+){2,})", r"\b(v?\d+\.\d+(?:\.\d+)*)\b", r"\b([\w-]+(?:\.[\w-]+)*:\d{2,5})\b", r"\b(\d+(?:\.\d+)?\s?(?:ms|s|GB|MB|KB|%))", r"\b([\w-]+\.(?:py|md|json|yaml|yml|js|ts|sh|sql|csv|txt))\b")
    found = F.concat(*(F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in kinds))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.char_length(x) >= 2)), 1, cap)


def sentences(s: Column) -> Column:
    """Sentences cut after full stops of either script and at line ends, trimmed, none blank."""
    return F.filter(F.transform(F.split(s, "[。！？\n]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def first_line(s: Column, most: int = 120) -> Column:
    """The first line that is no heading, at most ``most`` characters; null where there is none."""
    return F.substring(F.try_element_at(F.filter(lines(s), lambda x: ~x.startswith("#")), F.lit(1)), 1, most)


def heading_repaired(s: Column) -> Column:
    """``## ## x`` as ``## x``, line by line."""
    return F.regexp_replace(s, r"(?m)^(#{1,6})[ \t]+#{1,6}[ \t]+(\S.*)$", "$1 $2")


# Words that hold the place of a text.
PLACE_HOLDERS = ["todo", "tbd", "待补", "占位", "placeholder", "待补充", "内容待补"]


def is_placeholder(s: Column) -> Column:
    """Whether a text is nothing but marks, or one of ``PLACE_HOLDERS`` and marks after it; true for null and blank."""
    said = F.lower(F.btrim(F.coalesce(s, F.lit("")), F.lit(" \t\n\r\f\u000b")))
    return (F.translate(said, " \t\n\r\f\u000b-_.·•*", "") == "") | F.rtrim(said, F.lit(" \t\n\r\f\u000b-_.")).isin(PLACE_HOLDERS)


def number_in(s: Column, default: float) -> Column:
    """The first number in a text as double, ``default`` where there is none."""
    return F.coalesce(F.regexp_extract(s, r"[-+]?\d*\.?\d+", 0).try_cast("double"), F.lit(default))


def parse_tags(s: Column) -> Column:
    """Tags of ``[a, b]``, ``"a", 'b'`` or ``a b``: split at commas and white space, without quotes and brackets, distinct, in order."""
    inner = F.regexp_replace(F.trim(s), r"^\[|\]$", "")
    return F.array_distinct(F.filter(F.transform(F.split(inner, r"[,\s]+"), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")), lambda x: x != ""))


def nfkc(s: Column) -> Column:
    """Unicode NFKC with runs of blanks as one, trimmed. Spark has no such function; batches go through Arrow."""
    @F.pandas_udf(T.StringType())
    def apply(x: pd.Series) -> pd.Series:
        import re
        import unicodedata

        return x.map(lambda v: None if v is None else re.sub(r"[ \t\r\f\v]+", " ", unicodedata.normalize("NFKC", v)).strip())

    return apply(s)


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters by the logarithm of how many differ; 0 for texts with fewer than two different ones.

    Characters are sorted, so that equal ones are runs of some length k. With n
    characters the entropy is ``log2 n`` less the mean of ``log2 k``; only the runs
    are added up, one step for each different character.
    """
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    runs = F.regexp_extract_all(F.array_join(F.array_sort(chars), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    n, kinds = F.char_length(s).cast("double"), F.size(runs).cast("double")
    log = lambda r: F.char_length(r) * F.log2(F.char_length(r).cast("double"))
    mean = F.aggregate(runs, F.lit(0.0), lambda a, r: a + log(r)) / n
    return F.when(kinds <= 1, F.lit(0.0)).otherwise((F.log2(n) - mean) / F.log2(kinds))
