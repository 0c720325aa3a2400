"""Quality of notes: gates, content types, triage, confidence, diversity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as X

# Words that signal each content type, in order of precedence within either list.
SIGNALS = {
    "policy": ["必须", "禁止", "规范", "要求", "时效", "不得", "严禁", "应当", "需要"],
    "case": ["案", "判决", "裁定", "当事人", "原告", "被告", "案综", "案号", "审理"],
    "lesson": ["复盘", "教训", "根因", "踩坑", "经验", "反思", "总结", "改进"],
    "decision": ["决定", "决策", "选择", "方案", "敲定", "拍板", "确定", "决议"],
    "knowledge": ["原理", "机制", "规则", "流程", "定义", "概念", "说明", "结构"],
    "todo": ["TODO", "计划", "下一步", "安排", "待办", "跟进", "要做", "需要"],
}
CHAT_SIGNALS = {
    "chat_decision": ["决定", "方案", "确认", "就这么定", "同意", "通过", "定了", "敲定", "拍板"],
    "chat_knowledge": ["原理", "规则", "流程", "注意", "机制", "原因", "因为", "说明"],
    "chat_todo": ["TODO", "下次", "安排", "负责", "待办", "跟进", "要做", "需要"],
}
# Words of which one makes a short text a chat.
CHAT_MARKERS = ["嗯", "好的", "收到", "ok", "OK", "嗯嗯", "好", "行", "明白", "了解"]
#: How a message begins in the text of a chat: a day in brackets or a time of day, then who.
_DAY, _TIME, _WHO = r"\[\d{4}(?:[-/]\d{2}){2}[^\]]*\]\s*", r"\d{1,2}:\d{2}\s+", r"\S+:\s"
CHAT_LINE = f"(?:{_DAY}|{_TIME}){_WHO}"
ALL_SIGNALS = sorted({w for words in (SIGNALS | CHAT_SIGNALS).values() for w in words})


def gate(body: Column, status: Column, tier: Column) -> Column:
    """``verdict, hard, soft`` of a note: reject for a short or placeholder body or no status, quarantine for tier 5, repeated lines, marks or very long lines, else pass.

    A null body is an empty one; ``hard`` and ``soft`` name the reasons, ``soft`` only where nothing is hard.
    """
    b = F.coalesce(body, F.lit(""))
    lines = X.lines(b)
    n = F.size(lines)
    solid = F.regexp_replace(b, r"\s", "")
    marks = F.char_length(F.regexp_replace(solid, r"[\p{L}\p{N}]", ""))
    hard = F.filter(F.array(
        F.when(F.char_length(F.regexp_replace(b, r"^\s+|\s+$", "")) < 15, "short"), F.when(X.is_placeholder(b), "placeholder"),
        F.when(F.coalesce(F.trim(status), F.lit("")) == "", "no status")), lambda x: x.isNotNull())
    soft = F.filter(F.array(
        F.when(tier == 5, "tier 5"), F.when((n > 0) & ((n - F.size(F.array_distinct(lines))) / F.greatest(n, F.lit(1)) > 0.4), "repeated lines"),
        F.when((F.char_length(solid) > 0) & (marks / F.greatest(F.char_length(solid), F.lit(1)) > 0.45), "marks"),
        F.when(F.exists(lines, lambda x: F.char_length(x) > 1200), "long line")), lambda x: x.isNotNull())
    verdict = F.when(F.size(hard) > 0, "reject").when(F.size(soft) > 0, "quarantine").otherwise("pass")
    return F.struct(verdict.alias("verdict"), hard.alias("hard"), F.when(F.size(hard) > 0, F.array().cast("array<string>")).otherwise(soft).alias("soft"))


def chat_lines(body: Column) -> Column:
    """Lines that look like a message with its time and sender."""
    return F.regexp_count(body, F.lit(rf"(?m)^[^\n]*?(?:{CHAT_LINE})[^\n]*"))


def content_type(body: Column) -> Column:
    """``content_type, confidence``: noise, or the type whose signal words stand in the text most, the first of equals; chat types for chats, and a fallback where no word stands."""
    n, density = X.solid_length(body), X.keyword_density(body, ALL_SIGNALS)

    def best(signals: dict[str, list[str]], fallback: str) -> Column:
        counts = F.array(*(F.struct(X.present(body, w).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, w) in enumerate(signals.items())))
        top = F.array_max(counts)
        return F.when(top["n"] > 0, F.struct(top["k"].alias("content_type"), F.least(0.5 + 0.1 * top["n"], F.lit(0.95)).alias("confidence"))).otherwise(F.struct(F.lit(fallback).alias("content_type"), F.lit(0.5).alias("confidence")))

    noise = lambda c: F.struct(F.lit("noise").alias("content_type"), F.lit(c).alias("confidence"))
    return F.when(n < 15, noise(1.0)).when((density < 0.05) & (n < 200), noise(0.9)).when(chat_lines(body) >= 3, best(CHAT_SIGNALS, "chat")).otherwise(best(SIGNALS, "reference"))


def ingest_quality(body: Column) -> Column:
    """noise, chat, knowledge or reference by length, signal words and entropy."""
    n, density = X.solid_length(body), X.keyword_density(body, ALL_SIGNALS)
    lines = X.lines(body)
    short = F.size(F.filter(lines, lambda x: F.char_length(x) < 30))
    chatty = (X.present(body, CHAT_MARKERS) > 0) | ((short > F.size(lines) * 0.7) & (F.size(lines) > 2))
    return F.when(n < 15, "noise").when((density < 0.05) & (n < 200), "noise").when((n < 200) & (F.size(lines) > 0) & chatty, "chat").when((density >= 0.15) & (X.entropy(body) >= 0.7), "knowledge").otherwise("reference")


# What only answers, and how a line begins that only announces.
ANSWERS = ["好的", "好嘞", "收到", "明白", "稍等", "嗯嗯", "继续", "没问题", "哈哈", "谢谢", "okay", "got it", "好", "嗯", "哈", "ok"]
ANNOUNCES = ["我现在", "我接下来", "我先", "我再", "我们现在", "我们接下来", "我们先", "我们再", "让我", "下面我", "接下来我", "现在开始"]
#: Characters of a line that may count as repeated, and how often it has to stand.
SHORT_LINE, OFTEN = 40, 3


def boilerplate(body: Column) -> Column:
    """Share of lines that only answer, announce, or stand ``OFTEN`` times or more (short ones); 0 without lines.

    A line only answers if nothing but marks is left of it without ``ANSWERS``.
    """
    lines = X.lines(body)

    def answers(line: Column) -> Column:
        left = F.regexp_replace(F.lower(line), r"[^\p{L}\p{N} ]", "")
        bare = left
        for word in ANSWERS:
            bare = F.replace(bare, F.lit(word), F.lit(""))
        return (F.trim(left) != "") & (F.trim(bare) == "")

    def announces(line: Column) -> Column:
        return F.exists(F.array(*map(F.lit, ANNOUNCES)), lambda w: line.startswith(w))

    def share(all_lines: Column, told: Column, short: Column) -> Column:
        # among sorted lines, one of three or more equal ones has an equal line two places off, or equal ones on either side
        same = lambda x, i: F.coalesce(F.get(short, i) == x, F.lit(False))
        often = F.filter(short, lambda x, i: same(x, i - 2) | same(x, i + 2) | (same(x, i - 1) & same(x, i + 1)))
        n = F.size(all_lines)
        return F.when(n > 0, (n - F.size(told) + F.size(often)) / n).otherwise(F.lit(0.0))

    # each step is bound as an element of an array, so that it is made once
    told = lambda ls: F.filter(ls, lambda x: ~(answers(x) | announces(x)))
    short = lambda t: F.array_sort(F.filter(t, lambda x: F.char_length(x) <= SHORT_LINE))
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return bound(lines, lambda ls: bound(told(ls), lambda t: bound(short(t), lambda s: share(ls, t, s))))


def triage_score(text: Column, required: list[Column], similarity: Column, keywords: list[str]) -> Column:
    """0 to 100: a quarter each for required fields present, density of signal characters, being unlike others, and words of value."""
    there = sum((F.when(c.isNotNull() & (F.trim(c.cast("string")) != ""), 1).otherwise(0) for c in required), F.lit(0))
    d = X.signal_share(text)
    dense = F.when(d >= 0.15, 25).when(d >= 0.10, 18).when(d >= 0.05, 10).otherwise(3)
    unlike = F.when(similarity.isNull(), 25).when(similarity >= 0.85, 0).when(similarity >= 0.70, 10).otherwise(20)
    value = F.least(F.lit(25), 5 + 3 * X.present(text, keywords))
    return F.floor(25 * there / len(required)) + dense + unlike + value


def confidence(body: Column, sources: Column, updated: Column, as_of: Column) -> Column:
    """Weighted confidence of a note: how much of its list is marked as inferred, how many sources, how new; verification has no signal here and counts 0.4."""
    bullets = F.filter(X.lines(F.coalesce(body, F.lit(""))), lambda x: x.startswith("-"))
    ratio = F.size(F.filter(bullets, lambda x: F.contains(x, F.lit("^[推断]")))) / F.greatest(F.size(bullets), F.lit(1))
    extraction = F.round(0.9 - 0.6 * F.least(ratio, F.lit(0.5)), 3)
    corroboration = F.when(sources <= 0, 0.1).otherwise(F.round(F.least(F.lit(1.0), 0.35 + 0.65 * F.log2(F.greatest(sources, F.lit(1))) / 3), 3))
    age = F.datediff(as_of, updated)
    recency = F.when(age.isNull(), 0.7).when(age <= 90, 1.0).when(age >= 365, 0.15).otherwise(F.round(1 - 0.85 * (age - 90) / 275, 3))
    return F.round(0.5 * extraction + 0.25 * corroboration + 0.15 * recency + 0.1 * 0.4, 3)


def cutoff(scores: DataFrame, score: str, share: float) -> DataFrame:
    """One row ``cut``: of the sorted scores the one at place ``max(1, floor(n * share))``; no row for no scores.

    Scores are counted by value first, so that what is sorted is their distinct values.
    """
    counts = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("cut")).agg(F.count("*").alias("k"))
    n = counts.agg(F.sum("k").alias("n"))
    w = Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.withColumn("upto", F.sum("k").over(w)).crossJoin(n)
    return run.where(F.col("upto") >= F.greatest(F.lit(1), F.floor(F.col("n") * share))).agg(F.min("cut").alias("cut")).where("cut is not null")


def diversity(notes: DataFrame, by: str) -> DataFrame:
    """One row ``groups, simpson, shannon, top_share`` of how rows spread over the values of ``by``; null is a value."""
    counts = notes.groupBy(by).agg(F.count("*").alias("k"))
    p = counts.crossJoin(counts.agg(F.sum("k").alias("n"))).select((F.col("k") / F.col("n")).alias("p"))
    return p.agg(
        F.count("*").alias("groups"), F.round(1 - F.sum(F.col("p") * F.col("p")), 6).alias("simpson"),
        F.round(F.when(F.count("*") > 1, -F.sum(F.col("p") * F.log("p")) / F.log(F.count("*").cast("double"))).otherwise(0.0), 6).alias("shannon"), F.round(F.max("p"), 6).alias("top_share"))
