"""Readers and writers."""

import datetime as dt

from pyspark.sql import functions as F

from corpusmill.sources import formats, sinks


def test_vault_and_frontmatter(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "n.md").write_text("---\ntitle: 'T'\ntags: [x, \"y, z\"]\nempty:\n# no\nplain\ntitle: U\n---\nbody\n---\nmore")
    (tmp_path / ".git" / "x.md").write_text("no")
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "c.md").write_bytes(b"no head \xff")
    v = formats.vault(spark, str(tmp_path)).select("rel", formats.frontmatter(F.col("text")).alias("n")).select("rel", "n.*")
    got = {r.rel: r for r in v.collect()}
    assert set(got) == {"a/n.md", "c.md"}
    assert got["a/n.md"].fm == {"title": "U", "tags": "[x, \"y, z\"]", "empty": None} and got["a/n.md"].body == "body\n---\nmore"
    assert got["c.md"].fm == {} and got["c.md"].body.startswith("no head")
    numbered = spark.createDataFrame([("---\na: 10\nb: 21\nc: 32\n---\nx",)], "t string").select(formats.frontmatter(F.col("t"))["fm"].alias("fm")).first().fm
    assert numbered == {"a": "10", "b": "21", "c": "32"}
    assert v.where("rel = 'a/n.md'").select(formats.list_field(F.col("fm")["tags"]).alias("t")).first().t == ["x", "y, z"]


def test_html(spark):
    page = "<html><head><title>A &amp; b</title></head><body><nav>menu</nav><script>x()</script><p>One<br>two</p><div>3 &lt; 4</div><!-- c --></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("plain",)], "html string")
    assert [r.t for r in df.select(formats.html_text(F.col("html")).alias("t")).collect()] == ["One\ntwo\n\n3 < 4", None, "plain"]
    bad = spark.createDataFrame([("<p>a < b<P>c</p ><b>d<br/>e<script type=x>if (a<b) y()</script><p>\n\n<p>f &hellip;",)], "html string")
    assert bad.select(formats.html_text(F.col("html"))).first()[0] == "a < b\nc\nd\ne\n\nf …"


def test_mail(spark):
    raw = b"From: a@b.c\r\nSubject: Hi\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nhello\r\n"
    r = formats.mails(spark.createDataFrame([(bytearray(raw),), (None,)], "content binary")).collect()
    assert (r[0].sender, r[0].subject, r[0].text.strip()) == ("a@b.c", "Hi", "hello") and r[1].text is None


def test_json(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": "x"}]}, "d": null}'), (2, "[1, 2]"), (3, "nope"), (4, '{"tables": {"records": {"k": {"content": "t: 很长的标题：rest"}}}}'), (5, '{"thread_items": []}'), (6, '{"x": [1]}'), (7, '{"x": 1}')], "id long, j string")
    assert {r.id: r.k for r in df.select("id", formats.json_kind(F.col("j")).alias("k")).collect()} == {1: "generic", 2: "nested_array", 3: None, 4: "records", 5: "threads", 6: "nested_array", 7: "generic"}
    got = {(r.id, r.path): r.value for r in formats.json_leaves(df.where("id < 4"), "j").collect()}
    assert got == {(1, "a.b.0"): "1", (1, "a.b.1.c"): "x", (1, "d"): None, (2, "0"): "1", (2, "1"): "2"}
    m = formats.memory_records(df.where("id = 4"), "j").first()
    assert (m.id, m.title) == ("k", "t: 很长的标题")


def test_chats(spark):
    t = dt.datetime(2024, 1, 2, 3, 4)
    csv = spark.createDataFrame([("2024-01-02 03:04,A,\"x, y\"",), ("bad,A,b",), ("2024/01/02 03:04:00, B ,z",)], "value string")
    assert [(r.ts, r.sender, r.content) for r in formats.chat_csv(csv).collect()] == [(t, "A", "x, y"), (t, "B", "z")]
    js = spark.createDataFrame([('{"create_time": "1704164640000", "user_id": "u", "body": "b"}',), ('{"ts": "1704164640.000100", "user": "s", "text": "t", "thread_ts": "1.0"}',), ('{"sender": "x"}',)], "value string")
    got = formats.chat_json(js).collect()
    assert [(r.sender, r.content, r.thread_ts) for r in got] == [("u", "b", None), ("s", "t", "1.0")] and got[0].ts == t
    tx = spark.createDataFrame([("[2024-01-02 03:04] Z z: hi: x",), ("hello",)], "value string")
    assert [(r.ts, r.sender, r.content) for r in formats.chat_text(tx).collect()] == [(t, "Z z", "hi: x")]


def test_thread_turns(spark):
    rows = [("t", 1, "userMessage", '{"content": [{"text": "a"}, {"text": "b"}]}', 1), ("t", 1, "agentMessage", '{"text": "old"}', 2), ("t", 1, "agentMessage", '{"text": " new "}', 3), ("t", 2, "agentMessage", '{"text": "alone"}', 4), ("t", 1, "reasoning", '{"content": ["r", "s"]}', 5), ("t", 3, "userMessage", "broken", 6)]
    got = formats.thread_turns(spark.createDataFrame(rows, "thread_id string, turn_id long, item_type string, item_json string, created_at_ms long")).collect()
    assert [(r.turn_id, r.user, r.reply, r.reasoning, r.ts) for r in got] == [(1, "ab", "new", "rs", 1)]


def test_sinks(spark, tmp_path):
    f = str(tmp_path / "idx")
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    assert sinks.load_versioned(spark, f, ["a"], 8) is None
    sinks.save_versioned({"a": a}, f, 8)
    sinks.save_versioned({"a": a.withColumn("v", F.lit("y"))}, f, 8)
    assert sinks.load_versioned(spark, f, ["a"], 8)["a"].first().v == "y" and sinks.load_versioned(spark, f, ["a"], 9) is None
    sinks.append_ledger(a, str(tmp_path / "l"))
    sinks.append_ledger(a, str(tmp_path / "l"))
    assert formats.json_lines(spark, str(tmp_path / "l"), "id long, v string").count() == 2
    up = sinks.upserted(spark.createDataFrame([(1, "x", 5), (2, "z", 6)], "id long, v string, k int"), spark.createDataFrame([(1, "n"), (3, "m"), (2, None)], "id long, v string"), "id")
    assert sorted(map(tuple, up.collect())) == [(1, "n", 5), (2, "z", 6), (3, "m", None)]


def test_evidence_and_mermaid(spark):
    inc = spark.createDataFrame([("d", " a ", "s"), ("d", "a", "s0"), ("d", "b", "s"), ("d", "c", "t")], "domain string, body string, slug string")
    import hashlib

    stored = spark.createDataFrame([("d", hashlib.sha256(b"c").hexdigest(), "s")], "domain string, sha string, name string")
    got = sinks.new_evidence(inc, stored, "domain", "body", "slug").collect()
    assert sorted(r.name for r in got) == ["s-2", "s-3"]
    g = sinks.mermaid(spark.createDataFrame([("a", "A"), ("b", "B")], "id string, label string"), spark.createDataFrame([("a", "b", "is"), ("a", "z", "no")], "src string, dst string, kind string"))
    assert g == 'graph LR\n  n0["A"]\n  n1["B"]\n  n0 -->|is| n1'
