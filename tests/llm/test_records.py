"""Problems 5, 7, 9 and 10."""

import itertools
import json
import random

from corpusmill.llm import canonical, conversations, leakage, reading

S, M, P = "id string, title string", "id string, session_id string, time_created long, data string, role string", "id string, message_id string, session_id string, time_created long, data string"


def talk(spark, spec, known=None, extra=()):
    """``spec``: session -> list of (role, text); text None: no part."""
    ms, ps = [], []
    for s, turns in spec.items():
        for k, (role, text) in enumerate(turns):
            ms.append((f"{s}{k}", s, k // 2, json.dumps({"role": role}) if role is not None else "{}", "x"))
            if text is not None:
                ps.append((f"p{s}{k}", f"{s}{k}", s, k, json.dumps({"type": "text", "text": text})))
    ps += list(extra)
    return spark.createDataFrame([(s, None) for s in (known or spec)] * 2, S), spark.createDataFrame(ms + ms[:3], M), spark.createDataFrame(ps + ps[:2], P)


def turns(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.session_id, r.turn_no)):
        out.setdefault(r.session_id, []).append((r.turn_no, r.message_id, r.role))
    return out


U, A = ("user", "q"), ("Assistant", "r")
SPEC = {
    "a": [U, A, U, A, A], "b": [A, U, A], "c": [U, U, A], "d": [U], "e": [("system", "s"), U, ("assistant", " "), A], "f": [U, (None, "x"), A], "g": [("user", "　"), A], "h": [("USER", "q"), A, ("tool", "t")], "i": [("system", "s")], "j": [U, A], "k": [U, A],
}


def test_conversations(spark):
    args = talk(spark, SPEC, known=[s for s in SPEC if s != "j"], extra=[("x1", "k0", "k", 9, "{broken"), ("x2", "a0", "a", 9, '{"type": "tool", "text": "no"}')])
    for stretch in (100_000, 2):
        got = turns(conversations.conversation_turns(*args, stretch=stretch))
        assert set(got) == {"a", "e", "h"}
        assert got["a"] == [(1, "a0", "user"), (2, "a1", "assistant"), (3, "a2", "user"), (4, "a3", "assistant"), (5, "a4", "assistant")]
        assert [m for _, m, _ in got["e"]] == ["e1", "e3"]
    texts = {r.message_id: r.text for r in conversations.conversation_texts(*args).collect()}
    assert texts["a0"] == "q"
    assert conversations.conversation_turns(*(x.limit(0) for x in args)).collect() == []


def test_kahn():
    order, left = conversations.kahn([(5, "a"), (1, "b"), (1, "c"), (2, "d")], {"b": "a", "d": "b"})
    assert order == [2, 0, 1, 3] and left == 0
    assert conversations.kahn([(1, "a"), (2, "b"), (3, "c")], {"a": "b", "b": "a", "c": "gone"}) == ([2], 2)


def test_reply_column(spark):
    s, m, p = talk(spark, {"a": [U, A], "b": [U, A]})
    from pyspark.sql import functions as F

    m = m.withColumn("parent", F.expr("case id when 'a0' then 'a1' when 'a1' then 'a0' when 'b1' then 'b0' end"))
    assert set(turns(conversations.conversation_turns(s, m, p, reply_to="parent"))) == {"b"}


def osa(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_against_all_spellings():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 13))) for _ in range(150)]
    trie = canonical.Trie((w, i) for i, w in enumerate(words))
    for _ in range(200):
        v = list(rng.choice(words))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(v) + 1)
            v[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "e", "bc"])
        v = "".join(v) or "a"
        want = sorted((osa(v, w), i) for i, w in enumerate(words) if osa(v, w) <= canonical.slips(len(w)))
        assert trie.within(v) == want


def test_mapping(spark, monkeypatch):
    terms = spark.createDataFrame([(1, "domain", "platform", ["plat", None]), (2, "domain", "observability", ["obs"]), (3, "tag", "platform", None), (4, "tag", None, None), (5, None, "x", None), (6, "tag", "ops/on-call", ["值班"])], "term_id long, kind string, term string, aliases array<string>")
    notes = spark.createDataFrame([
        (1, "Platfrom", ["platform", "ＯＮ－call", " 值班 ", "值日", None, "", "--", "platform", "plarform", "plarform"], 9), (2, None, None, 9), (3, "obs", [], 9), (4, "ob", ["x"], 9), (5, "platform", None, 9), (6, "obzervabilitty", None, 9)],
        "note_id long, domain string, tags array<string>, term_id int")
    want = {(1, "domain", "Platfrom", 1), (1, "tags", "ＯＮ－call", 0), (1, "tags", " 值班 ", 6), (1, "tags", "值日", 0), (1, "tags", "plarform", 3), (3, "domain", "obs", 2), (4, "domain", "ob", 0), (4, "tags", "x", 0), (6, "domain", "obzervabilitty", 2)}
    assert set(map(tuple, canonical.map_typed(notes, terms).collect())) == want and canonical.map_typed(notes, terms).count() == len(want)
    monkeypatch.setattr(canonical, "BLOCK", 2)  # several passes give the same
    assert set(map(tuple, canonical.map_typed(notes, terms).collect())) == want
    assert {r.term_id for r in canonical.map_typed(notes, terms.limit(0)).collect()} == {0} and canonical.map_typed(notes.limit(0), terms).collect() == []


def test_all_candidates(spark, monkeypatch):
    terms = spark.createDataFrame([(1, "tag", "planner", ["plannar"]), (2, "tag", "planned", None), (3, "domain", "planner", None)], "term_id long, kind string, term string, aliases array<string>")
    values = spark.createDataFrame([("tag", "plannes", 1)] * 3 + [("tag", None, 1), (None, "planner", 1), ("tag", "--", 1), ("tag", "zzz", 1)], "kind string, value string, term_id int")
    want = {("tag", "plannes", 1, 1), ("tag", "plannes", 2, 1)}
    for block in (50_000, 1):
        monkeypatch.setattr(canonical, "BLOCK", block)
        got = [tuple(r) for r in canonical.candidates(values, terms, "kind", "value").collect()]
        assert set(got) == want and len(got) == 2
    back = [(r.value, r.term_id) for r in canonical.to_canonical(values, terms, "kind", "value").collect()]
    assert sorted(back, key=str) == sorted([("plannes", 1)] * 3 + [(None, 0), ("planner", 0), ("--", 0), ("zzz", 0)], key=str)


def test_leak_index_is_bounded():
    block = leakage.Items([(i, "".join(chr(97 + (i * k * k + k) % 26) for k in range(2000))) for i in range(50)], 40)
    size = block.codes.nbytes + block.minima.nbytes + block.windows.nbytes + block.at.nbytes
    assert size <= leakage.BYTES_A_CHAR * 100_000 and leakage.BYTES_A_CHAR * leakage.BLOCK_CHARS < 100_000_000


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abc 中文，.1") for _ in range(n))
    items = [(i, text(300)) for i in range(12)] + [(20, None), (21, ""), (22, "short"), (23, "Ab " * 30)]
    docs = []
    for i in range(80):
        it = items[rng.randrange(12)][1]
        k, n = rng.randrange(200), rng.randrange(20, 90)
        docs.append((i, text(rng.randrange(0, 500)) + it[k : k + n].upper() + text(rng.randrange(0, 300))))
    docs += [(90, None), (91, ""), (92, "x" * 39), (93, "aB-" * 5000), (0, docs[0][1])]
    monkeypatch.setattr(leakage, "PART_CHARS", 150)
    d, e = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, passage string")
    bare = {i: leakage.bare(t or "") for i, t in docs}
    want = {(i, j) for i, t in bare.items() for j, p in items if p and any(leakage.bare(p)[k : k + 40] in t for k in range(len(leakage.bare(p)) - 39))}
    got = leakage.leaks(d, e)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want) > 10
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 500)
    assert set(map(tuple, leakage.leaks(d, e).collect())) == want
    assert leakage.leaks(d.limit(0), e).collect() == [] and leakage.leaks(d, e.limit(0)).collect() == []


EASY, PLAIN, HARD = "the cat sat on my bed and we ate".split(), "server queue report budget manager restart update deadline".split(), "epistemic hierarchy notwithstanding canonical provenance commensurability axiom".split()


def test_reading_levels(spark):
    rng = random.Random(9)

    def write(words, n):
        return " ".join(" ".join(rng.choice(words) for _ in range(rng.randrange(4, 12))).capitalize() + "." for _ in range(n))

    docs, labels = [], []
    for i in range(240):
        level = i % 3 + 1
        other = (EASY, PLAIN, HARD)[rng.randrange(3)]
        docs.append((i, write((EASY, PLAIN, HARD)[level - 1], 8) + "\n\n" + write(other, 2) + "\n\n```\nepistemic code\n```\n"))
        if i < 120:
            labels.append((i, "r", level if rng.random() > 0.1 else 2))
    docs += [(900, None), (901, " \n"), (902, ""), (903, "12345 ..."), (904, "| a | b |"), (905, write(HARD, 3000)), (5, docs[5][1])]
    labels += [(7, "s", None), (9000, "r", 3), (3, "r", 9)]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, reading_level int")
    l = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int")  # noqa: E741
    got = [(r.doc_id, r.reading_level) for r in reading.reading_levels(d, l).collect()]
    level = dict(got)
    assert len(got) == 240 + 1 + 3 and not {900, 901, 902} & set(level) and level[905] == 3 and set(level.values()) <= {1, 2, 3}
    assert sum(level[i] == i % 3 + 1 for i in range(120, 240)) >= 118
    few = reading.reading_levels(d, l, rated=40).collect()
    assert len(few) == len(got)
    assert {r.reading_level for r in reading.reading_levels(d, l.limit(0)).collect()} == {2} and reading.reading_levels(d.limit(0), l).collect() == []


def test_both_terms_of_the_formula_decide():
    rng = random.Random(4)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    # levels 1 and 2 have one vocabulary and differ in the length of sentences; level 3 has words of its own
    write = lambda level: " ".join(say(HARD if level == 3 else EASY, 4 if level == 1 else 24) for _ in range(6))
    rated = [(write(k % 3 + 1), k % 3 + 1) for k in range(150)]
    f = reading.Formula.fit(set(EASY) | set(HARD), rated)
    share = lambda g: sum(g.level(write(k % 3 + 1)) == k % 3 + 1 for k in range(90)) / 90
    without = lambda *gone: reading.Formula(f.home, {s: [[0 if i in gone else v for i, v in enumerate(w)] for w in x] for s, x in f.weights.items()}, f.usual)
    assert share(f) >= 0.97 and share(without(3)) < 0.8 and share(without(1, 2)) < 0.8
    # a word in no list is outside both
    assert reading.Formula.terms({"we": 1}, ["we zzz zzz zzz."])[1:3] == (0.75, 0.75)
