"""Conversations rebuilt from message rows.

The messages of a session form a reply graph. Kahn's algorithm sorts it, always
taking the earliest message (then the smallest id) of those whose replied-to
message is placed; messages left over are in a cycle, and their session is
broken. Without reply edges the order is that of time and id.

A session without reply edges may be cut into stretches of time, each sorted by
a task of its own and joined by the stretch's summary (its turns, first and
last role), so that no task has to hold a session of unbounded length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import cut

#: Messages of one session that one task sorts; longer sessions are cut in time.
STRETCH = 100_000


def kahn(nodes: list[tuple], replies: dict) -> tuple[list, int]:
    """Places of ``nodes`` (``(time, id)``) in reply order, and how many are left over in cycles.

    ``replies`` gives the id that an id replies to; one that isn't among the nodes is no edge.
    """
    at = {node[1]: i for i, node in enumerate(nodes)}
    waiting: dict[int, list[int]] = {}
    ready = []
    for i, node in enumerate(nodes):
        parent = at.get(replies.get(node[1]))
        if parent is None:
            ready.append((node, i))
        else:
            waiting.setdefault(parent, []).append(i)
    heapq.heapify(ready)
    order = []
    while ready:
        _, i = heapq.heappop(ready)
        order.append(i)
        for child in waiting.pop(i, ()):
            heapq.heappush(ready, (nodes[child], child))
    return order, len(nodes) - len(order)


def complete_object(data: Column) -> Column:
    """Whether ``data`` is one complete JSON object; false for null."""
    wrapped = F.concat(F.lit("["), data, F.lit("]"))
    return F.coalesce(data.rlike(r"^\s*\{[\s\S]*\}\s*$") & F.try_parse_json(wrapped).isNotNull() & (F.json_array_length(wrapped) == 1), F.lit(False))


def _ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (``sid, chunk, t, id, parent, kind``) as turns with their place in the stretch.

    ``kind``: u user turn, a assistant turn. A stretch with a cycle gives a row of kind c.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []
        group: list[tuple] = []

        def close() -> None:
            if not group:
                return
            order, left = kahn([(t, i) for _, _, t, i, _, _ in group], {i: p for _, _, _, i, p, _ in group if p is not None})
            sid, chunk = group[0][:2]
            if left:
                out.append((sid, chunk, 0, None, "c", None))
            turns = [group[i] for i in order if group[i][5] in ("u", "a")]
            for n, turn in enumerate(turns, 1):
                out.append((sid, chunk, n, turn[3], turn[5], turns[n][5] if n < len(turns) else None))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["sid", "chunk", "n", "message_id", "kind", "next_kind"])
            out.clear()
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:2] != group[0][:2]:
                    close()
                    group.clear()
                group.append(row)
            if out:
                yield flush()
        close()
        yield flush()

    placed = rows.select("sid", "chunk", "t", "id", "parent", "kind").repartition("sid", "chunk").sortWithinPartitions("sid", "chunk")
    return placed.mapInArrow(run, "sid string, chunk bigint, n bigint, message_id string, kind string, next_kind string")


def conversation_turns(sessions: DataFrame, messages: DataFrame, parts: DataFrame, reply_to: str | None = None, stretch: int = STRETCH) -> DataFrame:
    """``session_id, turn_no, message_id, role`` of every turn of every whole conversation.

    ``sessions(id)``, ``messages(id, session_id, time_created, data)`` and
    ``parts(id, message_id, session_id, time_created, data)``; rows repeated
    unchanged count once, other columns are not read. A turn is a user or
    assistant message (letter case aside) with text in a part of type ``text``;
    white space is no text. Turns are numbered from 1 in reply order.

    A session has no rows if it is not in ``sessions``, has no turn, has a
    message or part whose data is null or no complete JSON object, a message
    without a role (missing, null or blank), a user message without text, a
    cycle of replies, does not begin with a user turn, or leaves a user message
    without an assistant turn before the next user message or the end. Rows
    with a null session are left out; null times sort first; equal times go by id.

    ``reply_to`` names a column of ``messages`` with the id replied to. Given,
    a session is sorted by one task; else one of more than ``stretch`` messages
    is cut in time. Empty tables give no rows.
    """
    m = messages.where("session_id is not null and id is not null").select(F.col("id").cast("string").alias("id"), F.col("session_id").alias("sid"), F.col("time_created").alias("t"), "data", (F.col(reply_to) if reply_to else F.lit(None)).cast("string").alias("parent")).distinct()
    role = F.lower(F.get_json_object("data", "$.role"))
    m = m.select("id", "sid", "t", "parent", complete_object(F.col("data")).alias("whole"), F.when(role.rlike(r"\S"), role).alias("role"))
    p = parts.select("message_id", F.col("session_id").alias("psid"), "data")
    p = p.select(F.col("message_id").cast("string").alias("message_id"), "psid", complete_object(F.col("data")).alias("whole"), (
        F.coalesce((F.get_json_object("data", "$.type") == "text") & F.get_json_object("data", "$.text").rlike(r"(?U)\S"), F.lit(False))
    ).alias("text"))
    of_message = p.groupBy(F.col("message_id").alias("id")).agg(F.max("text").alias("text"), F.min("whole").alias("parts_whole"))
    m = m.join(of_message, "id", "left").withColumn("text", F.coalesce("text", F.lit(False)))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    broken = ~F.col("whole") | F.col("role").isNull() | ~F.coalesce("parts_whole", F.lit(True)) | (user & ~F.col("text"))
    # of every session, from both tables: is anything in it broken, and how long is it
    facts = m.select("sid", broken.alias("bad"), F.lit(1).alias("one"), "t").unionByName(
        p.where("psid is not null and not whole").select(F.col("psid").alias("sid"), F.lit(True).alias("bad"), F.lit(0).alias("one"), F.lit(None).cast("long").alias("t")))
    facts = facts.groupBy("sid").agg(F.max("bad").alias("bad"), F.sum("one").alias("size"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    known = sessions.select(F.col("id").alias("sid")).where("sid is not null").distinct()
    facts = facts.where("not coalesce(bad, false) and size > 0").join(known, "sid", "left_semi").select("sid", "size", "t0", "t1")
    kind = F.when(user & F.col("text"), "u").when(assistant & F.col("text"), "a").otherwise("o")
    m = m.select("sid", "t", "id", "parent", kind.alias("kind")).join(facts, "sid")
    span = F.greatest(F.col("t1") - F.col("t0") + 1, F.lit(1)).cast("double")
    chunk = F.when(F.lit(reply_to is None) & (F.col("size") > stretch), F.coalesce(F.floor((F.col("t") - F.col("t0")) / span * F.ceil(F.col("size") / stretch)), F.lit(-1))).otherwise(0)
    # used twice, and sorted in Python: written once
    turns = cut(_ordered(m.withColumn("chunk", chunk.cast("long")).withColumn("t", F.coalesce(F.col("t").cast("long"), F.lit(-(1 << 62))))))
    summary = turns.groupBy("sid", "chunk").agg(
        F.max(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("turns"), F.max(F.when(F.col("n") == 1, F.col("kind"))).alias("first"), F.max(F.when((F.col("n") > 0) & F.col("next_kind").isNull(), F.col("kind"))).alias("last"),
        F.max((F.col("kind") == "c") | F.coalesce((F.col("kind") == "u") & (F.col("next_kind") == "u"), F.lit(False))).alias("bad"))
    along, whole = Window.partitionBy("sid").orderBy("chunk"), Window.partitionBy("sid")
    following = F.lead("first").over(along)
    summary = summary.select("sid", "chunk", "turns", F.first("first").over(along).alias("opening"), (F.col("bad") | ((F.col("last") == "u") & (F.coalesce(following, F.lit("u")) == "u"))).alias("bad"), F.coalesce(F.sum("turns").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    good = summary.select("sid", "chunk", "before", "opening", F.max("bad").over(whole).alias("bad")).where("not bad and opening = 'u'")
    return turns.where("n > 0").join(good, ["sid", "chunk"]).select(
        F.col("sid").alias("session_id"), (F.col("before") + F.col("n")).alias("turn_no"), "message_id", F.when(F.col("kind") == "u", "user").otherwise("assistant").alias("role"))


def conversation_texts(sessions: DataFrame, messages: DataFrame, parts: DataFrame, reply_to: str | None = None) -> DataFrame:
    """The turns of ``conversation_turns`` with ``text``: the message's text parts in order of time, then id, joined by line breaks."""
    turns = conversation_turns(sessions, messages, parts, reply_to)
    p = parts.select(F.col("id").cast("string").alias("pid"), F.col("message_id").cast("string").alias("message_id"), "time_created", "data").distinct()
    p = p.where(F.get_json_object("data", "$.type") == "text").withColumn("text", F.get_json_object("data", "$.text")).where(F.col("text").isNotNull())
    texts = p.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("time_created", "pid", "text"))).alias("p"))
    texts = texts.select("message_id", F.concat_ws("\n", F.transform("p", lambda x: x["text"])).alias("text"))
    return turns.join(texts, "message_id", "left").select("session_id", "turn_no", "message_id", "role", "text")
