"""Problems 4, 6 and 8."""

import random

import pytest

from corpusmill.llm import residue, splitting, tokens

CHUNKS = "chunk_id long, filename string, chunk_of string, body string, is_parent_index boolean, reason string, piece string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, f, "p.md", b, None, "r", "q") for i, (f, b) in enumerate(rows)], CHUNKS)


BAD = [
    ("{{title}}-c1.md", "Real text about the scheduler and its queue."), ("undefined-c2.md", "Real text, long enough."), ("%s-c1.md", "Real."), ("null-null-c3.md", "Real."), ("a-c1.md", "Owner: {{ name }}\n\nReal text."),
    ("a.md", "Written by ${author} on ${date}."), ("a.md", "Last change: <DATE>"), ("a.md", "负责人：【待填写：日期】"), ("a.md", "> #{owner} · #{status}"), ("a.md", "Dear [insert name], please read."), ("a.md", "本节由__OWNER__补充。\n\n内容"), ("a.md", "«topic»"),
    ("a.md", "Please enable JavaScript to view this page."), ("a.md", "Menu\n\n503 Service Unavailable\n\nhost/1.2"), ("a.md", "网关超时\n\n您访问的地址暂时无法打开，请稍后再试。编号 0f0c"), ("a.md", "Lorem ipsum dolor sit amet consectetur"), ("a.md", "asdf qwer foo bar baz"),
    ("a.md", "占位文本，稍后补上。占位文本，稍后补上。"), ("a.md", "## Steps\n\nTBD\n\n## Limits\n\n…"), ("a.md", '{"status":500,"message":"Internal Server Error"}'), ("a.md", "text text text text text"),
]
GOOD = [
    ("release-train-x-c1.md", "The template writes `{{ title }}` and `${date}` into each card before the note is saved."), ("a.md", "```jinja\n{% for x in y %}{{ x }}{% endfor %}\n```\nThe loop above prints one line per note."),
    ("a.md", "The set {a, b} has 12 members when <b>bold</b> marks are ignored."), ("a.md", "页面不存在的提示现在由 relin 统一返回，relin 共清理了 12 个旧链接。\n\n我们上周把门打开了，然后写下了名字。"), ("a.md", "TODO for relin: rotate the secret on Friday."),
    ("a.md", "After the move, 12 links of relin answered 404 Not Found, and we pointed them to a new folder.\n\nThe queue was drained by hand after the checksum differed."), ("a.md", None), ("a.md", ""), (None, "A sentence that stands for itself, and another one."), ("a.md", "这个字很空。我们略过了几行。"), ("a.md", "- [[a]] one\n- [[b]] two"),
]


def test_residue(spark):
    got = {r.chunk_id: r.reason for r in residue.classify(chunks(spark, BAD + GOOD)).collect()}
    assert [BAD[i] for i in range(len(BAD)) if got[i] is None] == []
    assert [(GOOD[i], got[len(BAD) + i]) for i in range(len(GOOD)) if got[len(BAD) + i]] == []
    kept = residue.without_residue(chunks(spark, BAD + GOOD))
    assert kept.count() == len(GOOD) and kept.columns[0] == "chunk_id"


def test_furniture_recurs(spark):
    line = "Our partner sites are listed below, thank you for visiting"
    rows = [("a.md", f"404 Not Found\n\n{line}.")] + [("b.md", f"{line}.\n\nContent number {i} of its own kind, told at some length.") for i in range(6)]
    df = chunks(spark, rows)
    from pyspark.sql import functions as F

    own = df.withColumn("chunk_of", F.concat(F.lit("s"), F.col("chunk_id")))
    assert {r.chunk_id: r.reason for r in residue.classify(own).collect()}[0] == "stand_in"
    assert {r.chunk_id: r.reason for r in residue.classify(df).collect()}[0] is None  # one source only
    assert residue.classify(own, recurring=8).where("reason is not null").count() == 0  # without the grouping the row is lost
    assert residue.classify(df.limit(0)).collect() == []


def test_long_lines_are_treated_alike(spark):
    page = "We are sorry. " + " ".join(f"Please enable JavaScript to view page {i}." for i in range(60))
    told = "Please enable JavaScript, they said. " + " ".join(f"Then relin wrote note {i} about the queue {'x' * (i + 1)}." for i in range(20))
    rows = [("a.md", page), ("a.md", told)] + [("b.md", f"We are sorry. Content {chr(97 + i)} of another kind, told at some length.") for i in range(6)]
    from pyspark.sql import functions as F

    own = chunks(spark, rows).withColumn("chunk_of", F.concat(F.lit("s"), F.col("chunk_id")))
    got = {r.chunk_id: r.reason for r in residue.classify(own).collect()}
    assert got[0] == "stand_in" and got[1] is None


def texts():
    rng = random.Random(3)
    words = lambda n: " ".join("w" * rng.randrange(1, 12) for _ in range(n))
    return ["\n\n".join(words(rng.randrange(5, 120)) for _ in range(40)), "x" * 7001, "😀" * 2001, "一句话。" * 900, "a\r\n" * 2000, ". ".join(words(9) for _ in range(200)), "y" * 2001, " " * 5000, "`" * 300_000]


@pytest.mark.parametrize("limit,overlap", [(2000, 500), (100, 7)])
def test_pieces(spark, limit, overlap):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(i, t, None, "p", 1) for i, t in rows] + [(90, None, None, "", 1), (91, "", None, "", 1), (92, "z" * limit, None, "", 1), (93, "z" * (limit + 1), True, "", 1), (94, "z" * (limit + 1), False, "", 1)], "id long, body string, is_parent_index boolean, piece string, piece_no int")
    got = {}
    for r in splitting.split_oversized(df, limit=limit, overlap=overlap).collect():
        got.setdefault(r.id, []).append((r.piece_no, r.piece, r.n_pieces))
    assert set(got) == {i for i, t in rows if len(t) > limit} | {94}
    for i, t in rows:
        if len(t) > limit:
            p = [x for _, x, _ in sorted(got[i])]
            assert [k for k, _, _ in sorted(got[i])] == list(range(1, len(p) + 1)) and got[i][0][2] == len(p)
            assert p[0] + "".join(x[overlap:] for x in p[1:]) == t and all(len(x) <= limit for x in p) and all(b[:overlap] == a[-overlap:] for a, b in zip(p, p[1:]))


def test_pieces_prefer_strong_boundaries(spark):
    t = "a" * 1200 + "\n\n" + "b" * 500 + ". " + "c" * 900
    df = spark.createDataFrame([(t, None)], "body string, is_parent_index boolean")
    assert splitting.split_oversized(df).where("piece_no = 1").first().piece == "a" * 1200 + "\n\n"
    early = spark.createDataFrame([("a" * 900 + "\n\n" + "b" * 1500, None)], "body string, is_parent_index boolean")
    assert splitting.split_oversized(early).where("piece_no = 1").first().piece == "a" * 900 + "\n\n"
    with pytest.raises(ValueError):
        splitting.split_oversized(df, limit=100, overlap=50)


def test_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = "ab1 \n\t'’.,-_é中文😀　​<|endoftext|>ZЖ"
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))) for _ in range(300)] + ["<|endoftext|>", "it's they'll", " " * 5000, "a" * 30_000, "好" * 3000, "x\x00y"]
    want = [e.ids for e in t.encode_batch(rows, add_special_tokens=False)]
    df = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(rows)] + [(-1, None, None), (-2, "", None)], "doc_id long, text string, ids array<int>")
    for stretch in (100_000, 50):
        got = {r.doc_id: list(r.ids) for r in tokens.encode(df, stretch=stretch).collect()}
        assert [got[i] for i in range(len(rows))] == want and got[-1] == got[-2] == []
    back = tokens.decode(tokens.encode(df))
    assert {r.doc_id: r.text for r in back.collect()} == {i: x for i, x in enumerate(rows)} | {-1: "", -2: ""}
    assert tokens.encode(df.limit(0)).collect() == [] and tokens.encode(df).schema["ids"].dataType.simpleString() == "array<bigint>"
