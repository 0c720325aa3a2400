"""Queries of the core by name, and SQL that gives the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators import sessions as session_ops
from corpusmill.plans import activity, records, relations, retrieval, texts
from corpusmill.sources.tables import table

FLAGSHIP = "hybrid_retrieve"


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of every sender."""
    return session_ops.sessions(table(spark, folder, "chat_message"), "sender", "ts", "msg_id").select("sender", "start_time", "end_time")


def p2_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of every sender with their length and number of messages."""
    return session_ops.sessions(table(spark, folder, "chat_message"), "sender", "ts", "msg_id").selectExpr("sender", "start_time", "end_time", "cast(duration_s as bigint) as duration_s", "cast(n_events as bigint) as n_events")


QUERIES = {"p2_found": p2_found, "p2_sessions": p2_sessions} | retrieval.QUERIES | texts.QUERIES | relations.QUERIES | activity.QUERIES | records.QUERIES

_P2 = r"""
WITH rows AS (SELECT DISTINCT lower(regexp_replace(sender, '^\s+|\s+$', '', 'g')) AS sender, ts, msg_id FROM chat_message WHERE ts IS NOT NULL AND sender IS NOT NULL),
marked AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM rows WHERE sender <> '' WINDOW w AS (PARTITION BY sender ORDER BY ts)),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY sender ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS s FROM marked)
"""
SQL = {
    "p2_found": _P2 + "SELECT sender, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_time FROM numbered GROUP BY sender, s",
    "p2_sessions": _P2 + "SELECT sender, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_time, CAST(floor(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) AS BIGINT) AS duration_s, count(*) AS n_events FROM numbered GROUP BY sender, s",
} | retrieval.SQL | texts.SQL | relations.SQL | activity.SQL | records.SQL
