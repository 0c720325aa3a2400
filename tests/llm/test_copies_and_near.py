"""Problems 1 and 3."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import formatting, near
from corpusmill.operators import sketches

SCHEMA = "note_id long, rel string, body string, first_id long, _t0 string"


def notes(spark, rows):
    return spark.createDataFrame([(i, r, b, 5, "x") for i, r, b in rows], SCHEMA)


def groups(df):
    return {r.note_id: (r.first_id, r.n_copies) for r in df.collect()}


def test_formats_agree(spark):
    rows = [
        (1, "A/b.md", "Hello,  World"), (2, "a b MD", "hello\nworld!"), (3, "a/c.md", "hello world"),
        (4, "k", "- One: x 1\n- Two: y"), (5, "K", "two : Y\n\nONE: X-1\n"), (6, "k", '{"two": "y", "One": "x1"}'), (7, "k", "One: y\nTwo: x 1"),
        (8, "n", None), (9, "n", None), (10, "n", "..."), (11, "n", "---"), (12, None, "same"), (13, "", "same"), (14, "a b MD", "hello\nworld!"), (14, "a b MD", "hello\nworld!"),
        (15, "j", '{"a": {"b": 1}}'), (16, "j", '{ "a" : {"b":1 } }'), (17, "j", '{"a": 1'), (18, "o", "x: 1"), (19, "o", "1: x"),
    ]
    got = groups(formatting.format_copies(notes(spark, rows)))
    assert got[1] == got[2] == got[14] == (1, 3) and got[3] == (3, 1)
    assert got[4] == got[5] == got[6] == (4, 3) and got[7] == (7, 1)
    assert [got[i] for i in (8, 9, 10, 11)] == [(8, 1), (9, 1), (10, 1), (11, 1)]
    assert got[12] == got[13] == (12, 2) and got[15] == got[16] == (15, 2) and got[17] == (17, 1) and got[18] != got[19]


def test_empty_and_long(spark):
    assert formatting.format_copies(notes(spark, [])).collect() == []
    long = "word " * 200_000
    got = groups(formatting.format_copies(notes(spark, [(1, "r", long), (2, "R", long.upper()), (3, "r", long + "x")])))
    assert got == {1: (1, 2), 2: (1, 2), 3: (3, 1)}


def test_hot_group(spark):
    rows = [(i, "hot", "copy me" if i % 3 else f"own {i}") for i in range(3000)]
    got = groups(formatting.format_copies(notes(spark, rows)))
    assert got[2] == (1, 2000) and got[3] == (3, 1)


def body(rng, n=60):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def changed(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = body(rng, 1)
    return " ".join(w)


def jaccard(a, b):
    a, b = ("".join(x.lower().split()) for x in (a, b))
    a, b = ({x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, None, body(rng)) for i in range(60)]
    rows += [(100 + i, None, changed(rng, rows[i % 60][2], 1 + i % 9)) for i in range(120)]
    rows += [(300, None, rows[0][2].upper()), (301, None, rows[0][2].replace(" ", "\n")), (302, None, None), (303, None, "short"), (304, None, ""), (0, None, rows[0][2])]
    got = {(r.a, r.b): r.score for r in near.near_pairs(notes(spark, rows)).collect()}
    long = {i: b for i, _, b in rows if b and len("".join(b.split())) > 200}
    want = {(a, b): jaccard(long[a], long[b]) for a in long for b in long if a < b}
    want = {k: v for k, v in want.items() if v >= 0.7}
    assert len(want) > 30 and got == pytest.approx(want)


def test_groups_and_many_copies(spark):
    rng = random.Random(8)
    base = body(rng)
    rows = [(i, None, base) for i in range(30)] + [(50, None, changed(rng, base, 2)), (60, None, body(rng))]
    got = {r.note_id: r for r in near.near_groups(notes(spark, rows)).collect()}
    assert got[50].group_id == got[7].group_id == 0 and got[50].n_links == 1 and got[7].n_copies == 30 and got[60].group_id == 60 and got[60].n_links == 0
    few = {(r.a, r.b) for r in near.near_pairs(notes(spark, rows), copies=10).collect()}
    assert few == {(0, i) for i in range(1, 30)} | {(0, 50)}
    assert near.near_pairs(notes(spark, [])).collect() == [] and near.near_groups(notes(spark, [])).collect() == []


def test_pairs_and_membership_are_the_whole(spark):
    rng = random.Random(12)
    base = body(rng)
    rows = [(i, None, base) for i in range(12)] + [(20 + i, None, changed(rng, base, 2)) for i in range(3)] + [(30 + i, None, rows_) for i, rows_ in enumerate([body(rng)] * 2)]
    whole = {(r.a, r.b) for r in near.near_pairs(notes(spark, rows)).collect()}
    few = {(r.a, r.b) for r in near.near_pairs(notes(spark, rows), copies=5).collect()}
    of = {r.note_id: r.class_id for r in near.near_groups(notes(spark, rows)).collect()}
    members = {}
    for i, c in of.items():
        members.setdefault(c, []).append(i)
    grown = {(min(x, y), max(x, y)) for a, b in few for x in members[of[a]] for y in members[of[b]] if x != y} | {(x, y) for m in members.values() for x in m for y in m if x < y}
    assert len(few) < len(whole) == len(grown) and whole == grown


def test_distance_bound(spark):
    assert sketches.most_apart(0.7, 108) == 52
    df = spark.createDataFrame([([0x10, -1], [0x01, -1]), ([0, 0], [-1, 0]), ([5, 0], [5, 1 << 60])], "p array<long>, q array<long>")
    assert [r[0] for r in df.select(sketches.apart("p", "q", 32)).collect()] == [2, 16, 1]


def test_fingerprint_is_stable(spark):
    t = spark.createDataFrame([(1, "x" * 300), (2, "abcde" * 60)], "id long, t string")
    a, b = (sketches.fingerprints(t.repartition(n)).orderBy("id").collect() for n in (1, 2))
    assert a == b and len(a[0]["keys"]) == 108 and len(a[0]["bits"]) == 7 and [r["size"] for r in a] == [1, 5]
    assert t.select(near.squeezed(F.lit("A b　C"))).first()[0] == "abc"
