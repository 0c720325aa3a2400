"""Core operators against plain Python on small rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.operators import chunks, evaluate, graph, index, quality, recall, similarity, sketches, temporal
from corpusmill.operators.sessions import sessions

T0 = dt.datetime(2024, 3, 1, 10, 0, 0)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def ev(spark, rows):
    return spark.createDataFrame([(s, None if t is None else T0 + dt.timedelta(seconds=t), i) for s, t, i in rows], "sender string, ts timestamp_ntz, id long")


def test_sessions_gap_and_order(spark):
    rows = [("A ", 0, 1), (" a", 1800, 2), ("a", 3601, 3), ("a", 1800, 2), ("b", 5, 9), (None, 5, 4), ("  ", 5, 5), ("a", None, 6)]
    out = {(r.sender, r.start_time, r.end_time): r for r in sessions(ev(spark, rows), "sender", "ts", "id").collect()}
    assert set(out) == {("a", "2024-03-01 10:00:00", "2024-03-01 10:30:00"), ("a", "2024-03-01 11:00:01", "2024-03-01 11:00:01"), ("b", "2024-03-01 10:00:05", "2024-03-01 10:00:05")}
    first = out["a", "2024-03-01 10:00:00", "2024-03-01 10:30:00"]
    assert first.n_events == 2 and first.duration_s == 1800


def test_sessions_fractions_before_1970_and_clashing_columns(spark):
    base = dt.datetime(1969, 12, 31, 23, 50)
    df = spark.createDataFrame([("x", base + dt.timedelta(microseconds=1), 1, "k", 7), ("x", base + dt.timedelta(minutes=30, microseconds=1), 2, "k", 7), ("x", base + dt.timedelta(minutes=60, microseconds=2), 3, "k", 7)], "sender string, ts timestamp_ntz, id long, start_time string, _t int")
    out = rows_of(sessions(df, "sender", "ts", "id").select("start_time", "end_time"))
    assert out == [("1969-12-31 23:50:00", "1970-01-01 00:20:00"), ("1970-01-01 00:50:00", "1970-01-01 00:50:00")]


def test_sessions_random_against_scan(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.randrange(0, 200_000), i) for i in range(600)]
    got = rows_of(sessions(ev(spark, rows), "sender", "ts", "id").select("sender", "start_time", "end_time", "n_events"))
    want = []
    for s in "abc":
        run = []
        for t in sorted(t for a, t, _ in rows if a == s):
            if run and t - run[-1] > 1800:
                want.append((s, run))
                run = []
            run.append(t)
        want.append((s, run))
    f = lambda t: (T0 + dt.timedelta(seconds=t)).strftime("%Y-%m-%d %H:%M:%S")
    assert got == sorted(((s, f(r[0]), f(r[-1]), len(r)) for s, r in want), key=str)


def test_sessions_in_another_zone(spark):
    rows = [("a", 0, 1), ("a", 1800, 2), ("a", 86_400 * 30 + 5, 3)]
    want = rows_of(sessions(ev(spark, rows), "sender", "ts", "id"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows_of(sessions(ev(spark, rows), "sender", "ts", "id")) == want and want[0][1] == "2024-03-01 10:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sessions_empty(spark):
    assert sessions(ev(spark, []), "sender", "ts").collect() == []


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"s {kind}").select(column(F.col("s")).alias("x")).first().x


def test_tokens(spark):
    assert one(spark, X.tokens, "Ab3 中，文x字") == ["ab3", "x", "中", "中文", "文", "文字", "字"]
    assert one(spark, X.tokens, "") == []
    assert one(spark, X.tokens, None) is None
    assert one(spark, X.token_count, "abcdefgh 中文") == 4
    assert one(spark, X.unigrams, "A中b文") == ["a", "b", "中", "文"]
    assert one(spark, X.char_pairs, "A  bc") == ["a ", " b", "bc"]
    assert one(spark, X.shingles, "ab cd e fab cde") == ["abcde", "bcdef", "cdefa", "defab", "efabc", "fabcd"]


@pytest.mark.parametrize("text", ["", "a", "aaaa", "abab", "hello world", "你好你好吗", "x" * 500 + "y"])
def test_entropy(spark, text):
    n, counts = len(text), {c: text.count(c) for c in set(text)}
    want = 0.0 if len(counts) <= 1 else -sum(k / n * math.log2(k / n) for k in counts.values()) / math.log2(len(counts))
    assert one(spark, X.entropy, text) == pytest.approx(want, abs=1e-9)


def test_text_bits(spark):
    assert one(spark, X.wiki_targets, "see [[a#x|y]] and `[[no]]` [[ b ]] [[#z]]") == ["a", "b"]
    assert one(spark, X.path_stem, "x/y/z-1.md") == "z-1"
    assert one(spark, X.heading_repaired, "## ## t\n# ok") == "## t\n# ok"
    assert one(spark, X.is_placeholder, " --- ") and one(spark, X.is_placeholder, "待补") and not one(spark, X.is_placeholder, "text")
    assert one(spark, X.parse_tags, "[a, 'b c', \"d\"]") == ["a", "b", "c", "d"]
    assert one(spark, X.nfkc, "ＡＢ　ｃ\t d") == "AB c d"
    assert one(spark, X.first_line, "# h\n\n body \nx") == "body"


def test_fences_and_headings_stay_whole(spark):
    fence = "```py\nx = 1\n\n# no heading\n" + "y = 2\n" * 20 + "```"
    text = "# t\nintro\n\n" + fence + "\n\n---\n## a\nmore\n~~~\nopen"
    assert list(chunks._blocks(text)) == ["# t", "intro", fence, "---", "## a", "more", "~~~\nopen"]
    got = [r.chunk for r in chunks.paragraph_chunks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", size=160, overlap=10).collect()]
    assert any(fence in c for c in got) and all(len(c) <= 160 for c in got)
    df = spark.createDataFrame([(1, "s"), (2, "d" * 300), (3, "h" * 1500 + "\n## x\n" + "k" * 900), (4, ("word " * 100 + "\n\n") * 40), (5, " "), (6, None)], "id long, t string")
    routes = {}
    for r in chunks.routed_chunks(df, "id", "t").collect():
        routes.setdefault((r.id, r.route), []).append(r.chunk_no)
    assert {k: len(v) for k, v in routes.items() if k[1] != "semantic"} == {(1, "aggregate"): 1, (2, "direct"): 1, (3, "headings"): 2} and len(routes[4, "semantic"]) > 5


def test_boilerplate_and_gate(spark):
    assert one(spark, quality.boilerplate, "好的\n内容很长的一行文字在这里\nx x\nx x\nx x\n让我看看") == pytest.approx(5 / 6)
    g = spark.createDataFrame([("short", "active", 1), ("a real body of enough length here", None, 1), ("a real body of enough length here", "active", 5), ("a real body of enough length here", "active", 2)], "b string, s string, t int")
    assert [r.v for r in g.select(quality.gate(F.col("b"), F.col("s"), F.col("t"))["verdict"].alias("v")).collect()] == ["reject", "reject", "quarantine", "pass"]
    assert one(spark, lambda c: quality.content_type(c)["content_type"], "必须必须 禁止 这是一条规范，要求所有人遵守，时效为三天" * 3) == "policy"


def test_cutoff(spark):
    s = spark.createDataFrame([(float(i),) for i in range(1, 41)], "x double")
    assert quality.cutoff(s, "x", 0.1).first().cut == 4.0
    assert quality.cutoff(s.limit(3), "x", 0.03).first().cut == min(r.x for r in s.limit(3).collect())
    assert quality.cutoff(s.limit(0), "x", 0.1).collect() == []


def test_index_against_python(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "green", 4: None}
    i = index.build_index(spark.createDataFrame(list(docs.items()), "d long, t string"), "d", F.col("t"))
    idf = {r.term: r.idf for r in i.terms.collect()}
    assert idf["fox"] == pytest.approx(math.log(5 / 3) + 1)
    norms = {r.doc: r.norm for r in i.docs.collect()}
    assert norms[1] == pytest.approx(math.hypot(2 * idf["red"], idf["fox"])) and norms[4] == 1.0
    q = index.query_terms(spark.createDataFrame([(9, "fox fox zzz")], "q long, t string"), "q", F.col("t"))
    cos = {r.doc: r.score for r in index.cosine(i, q).collect()}
    assert cos[2] == pytest.approx(idf["fox"] / norms[2])
    bm = {r.doc: r.score for r in index.bm25(i, q).collect()}
    avg = (3 + 2 + 1 + 0) / 4
    assert bm[2] == pytest.approx(2 * math.log((4 - 2 + 0.5) / 2.5 + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / avg)))


def index_rows(i):
    return [sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str) for df in (i.postings, i.terms, i.docs, i.stats)]


def test_updated_index_equals_a_full_build(spark):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice("red blue fox hen 中文 词语".split()) for _ in range(rng.randrange(0, 30)))
    old = {i: text() for i in range(60)} | {70: None}
    new = {i: t for i, t in old.items() if i % 7} | {3: "changed fox", 70: None, 71: "", 80: "new hen", 5: None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "d long, t string")
    first = index.build_index(frame(old), "d", F.col("t"))
    assert index_rows(index.updated_index(first, frame(new), "d", F.col("t"))) == index_rows(index.build_index(frame(new), "d", F.col("t")))
    nothing = index.updated_index(first, frame(old).limit(0), "d", F.col("t"))
    assert nothing.postings.collect() == [] and nothing.stats.first() == (0, 0.0)


def test_asked_folders_only(spark):
    i = index.build_index(spark.createDataFrame([(k, f"w{k} all") for k in range(300)], "d long, t string"), "d", F.col("t"))
    q = index.query_terms(spark.createDataFrame([(1, "w7 all")], "q long, t string"), "q", F.col("t"))
    kept = index.asked_postings(i, q)
    assert kept.select("bucket").distinct().count() <= 2 and index.scores(i, q).count() == 300
    assert "PartitionFilters: [bucket" in kept._jdf.queryExecution().toString()


def test_rrf(spark):
    both = spark.createDataFrame([(1, 5, 0.4, 9.0), (1, 6, 0.3, 9.5), (2, 6, 0.3, 1.0)], "query long, doc long, cosine double, bm25 double")
    assert rows_of(index.rrf(both)) == [(1, 5, 1 / 61 + 1 / 62), (1, 6, 1 / 62 + 1 / 61), (2, 6, 2 / 61)]
    assert rows_of(index.rrf(both, cap=1)) == [(1, 5, 1 / 61), (1, 6, 1 / 61), (2, 6, 2 / 61)]


def test_dense_top_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vec = {i: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)] for i in range(200)}
    v = spark.createDataFrame([*vec.items(), (900, None)], "vec_id long, embedding array<float>").repartition(5)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    want = {q: [d for _, d in sorted((-dot(vec[q], x), d) for d, x in vec.items() if dot(vec[q], x) > 0)][:7] for q in range(0, 200, 20)}
    for most in (64_000_000, 200):
        monkeypatch.setattr(index, "QUERY_BYTES", most)
        got = {}
        for r in index.dense_top(v, v.where("vec_id % 20 = 0"), 7).orderBy("rank").collect():
            got.setdefault(r.query, []).append(r.doc)
        assert got == {q: d for q, d in want.items() if d}
    assert index.dense_top(v, v.limit(0), 7).collect() == []


def test_candidates_hold_every_passage(spark):
    texts = {1: "the quick brown fox jumps", 2: "xthe quick brown foxy", 3: "中文的词语很多", 4: "nothing", 5: "quick brown"}
    i = index.build_index(spark.createDataFrame(list(texts.items()), "d long, t string"), "d", F.col("t"))
    p = {1: "he quick brown fox", 2: "文的词", 3: "ick bro", 4: "absent words here"}
    got = {(r.query, r.doc) for r in index.candidates(i, spark.createDataFrame(list(p.items()), "q long, p string"), "q", "p").collect()}
    assert {(q, d) for q in (1, 2) for d, t in texts.items() if p[q] in t} <= got and not any(q in (3, 4) for q, _ in got)


def test_hot_keys_meet_in_blocks(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 6}") for i in range(300)], "id long, k string")
    b = similarity.in_blocks(rows, "k", "id", most=20)
    assert max(r["count"] for r in b.groupBy("k", "_a", "_b").count().collect()) < 80
    p, q = b.alias("p"), b.alias("q")
    got = [tuple(r) for r in p.join(q, similarity.once("k") & (F.col("p.id") < F.col("q.id"))).select("p.id", "q.id").collect()]
    k = dict(map(tuple, rows.collect()))
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in k for j in k if i < j and k[i] == k[j]}


def test_near_texts_recall(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = {}
    for i in range(80):
        w = [rng.choice(words) for _ in range(60)]
        for k in range(4):
            texts[len(texts)] = "".join(w)
            for _ in range(k + 1):
                w[rng.randrange(60)] = rng.choice(words)
    rows = spark.createDataFrame([*texts.items(), (900, texts[0]), (901, texts[0])], "id long, t string")
    members, first = sketches.classes(rows)
    grams = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in texts.items()}
    score = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = {(a, b) for a in texts for b in texts if a < b and texts[a] != texts[b] and score(a, b) >= 0.7}
    got = {(r.a, r.b): r.score for r in sketches.near_texts(first, 0.7).collect()}
    assert len(want) > 200 and len(want & set(got)) >= 0.99 * len(want) and all(got[p] == pytest.approx(score(*p)) for p in got)
    assert {r.id: (r.rep, r.n) for r in members.collect()}[901] == (0, 3)


def test_jaccard_and_cosine_pairs_are_exact(spark):
    rng = random.Random(1)
    sets = {i: {rng.randrange(30) for _ in range(rng.randrange(1, 12))} for i in range(60)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(99, [])], "id long, s array<long>")
    got = {(r.a, r.b): r.jaccard for r in similarity.jaccard_pairs(df, "id", "s", 0.5).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert got == pytest.approx({k: v for k, v in want.items() if v >= 0.5})
    vec = {i: {t: rng.random() + 0.1 for t in s} for i, s in sets.items()}
    w = spark.createDataFrame([(i, t, x) for i, v in vec.items() for t, x in v.items()], "doc long, term long, w double")
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    cos = {(a, b): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) / norm[a] / norm[b] for a in vec for b in vec if a < b}
    got = {(r.a, r.b): r.cosine for r in similarity.cosine_pairs(w, 0.6).collect()}
    assert got == pytest.approx({k: v for k, v in cos.items() if v >= 0.6})


def test_temporal(spark):
    rng = random.Random(2)
    iv = [(i, rng.choice("ab"), s, s + rng.randrange(0, 50)) for i, s in enumerate(rng.randrange(300) for _ in range(80))] + [(100, "a", None, 10), (101, "a", 290, None), (102, None, 1, 2), (103, "a", 9, 3)]
    got = set(rows_of(temporal.overlapping_pairs(spark.createDataFrame(iv, "id long, k string, s long, e long"), "id", ["k"], "s", "e", 20)))
    lo, hi = min(x for _, _, s, e in iv for x in (s, e) if x is not None), max(x for _, _, s, e in iv for x in (s, e) if x is not None)
    f = [(i, k, lo if s is None else s, hi if e is None else e) for i, k, s, e in iv]
    f = [x for x in f if x[2] <= x[3] and x[1]]
    assert got == {(a[0], b[0]) for a in f for b in f if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    left = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(1000)) for i in range(60)] + [(90, None, 5), (91, "a", None)], "i long, k string, t long")
    right = spark.createDataFrame([(rng.choice("ab"), rng.randrange(1000), j) for j in range(40)], "k string, t long, v long")
    r = right.collect()
    for strict in (False, True):
        for x in temporal.as_of(left, right, "k", "t", "v", 37, strict).collect():
            c = [(y.t, y.v) for y in r if y.k == x.k and x.t is not None and (y.t < x.t if strict else y.t <= x.t)]
            assert (x.at_right, x.v) == (max(c) if c else (None, None))


def test_next_within(spark):
    rows = [(1, "a", 0), (2, "a", 50), (3, "a", 50), (4, "a", 151), (5, "b", 20), (6, "a", 99)]
    got = rows_of(temporal.next_within(spark.createDataFrame(rows, "id long, k string, t long"), "id", ["k"], "t", 50))
    assert got == [(1, 2, 50), (2, 3, 0), (3, 6, 49)]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (7, 7), (None, 1), (6, 8), (8, 9), (9, 10)], "u long, v long")
    assert dict(rows_of(graph.components(e, "u", "v"))) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 8: 5, 9: 5, 10: 5, 7: 7}
    assert graph.components(e.limit(0), "u", "v").collect() == []
    assert rows_of(graph.reachable(e, "u", "v", spark.createDataFrame([(5,)], "id long"), 2)) == [(5, 0), (6, 1), (8, 2)]
    chain = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("x", "gone"), ("y", "y")], "n string, p string")
    assert {r.id: (r.root, r.hops) for r in graph.roots(chain, "n", "p").collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("a", 3), "x": ("x", 0), "y": ("y", 0)}


def test_components_of_random_graph(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = {x: min(y for y in range(300) if find(y) == find(x)) for e in edges for x in e}
    assert dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect())) == want


def test_recall(spark):
    df = spark.createDataFrame([(10.0, 10.0), (0.0, 5.0), (3.0, 0.0)], "t double, s double")
    assert [round(r.r, 6) for r in df.select(recall.retrievability(F.col("t"), F.col("s")).alias("r")).collect()] == [0.9, 1.0, 0.0]
    one_review = recall.Memory().after(3, 0)
    assert one_review.stability == 2.3065 and one_review.reps == 1
    reviews = [("k", float(d), g) for d, g in ((0, 3), (2, 3), (2.2, 1), (9, 4))]
    state, last = recall.Memory(), None
    for _, d, g in reviews:
        state, last = state.after(g, 0 if last is None else d - last), d
    rng = random.Random(1)
    rng.shuffle(reviews)
    got = recall.recall_states(spark.createDataFrame(reviews + [(None, 1.0, 2)], "i string, d double, g int"), "i", "d", "g").first()
    assert (got.stability, got.difficulty, got.reps, got.lapses) == (state.stability, state.difficulty, 4, 1)
    # columns agree with the plain form
    c = spark.createDataFrame([(5.0, 8.0, 4.0, g) for g in (1, 2, 3, 4)], "d double, s double, t double, g int")
    r = recall.retrievability(F.col("t"), F.col("s"))
    for x in c.select("*", recall.next_stability(F.col("d"), F.col("s"), r, F.col("g")).alias("ns"), recall.next_difficulty(F.col("d"), F.col("g")).alias("nd")).collect():
        want = recall.Memory(8.0, 5.0, 1, 0).after(x.g, 4.0)
        assert (round(x.ns, 4), round(x.nd, 4)) == (want.stability, want.difficulty)


def test_evaluate(spark):
    s = spark.createDataFrame([(0.9, True), (0.8, False), (0.7, True), (None, True), (0.3, None)], "s double, y boolean")
    got = {r.threshold: (r.precision, r.recall) for r in evaluate.threshold_sweep(s, "s", "y", 70, 90, 10).collect()}
    assert got == {0.7: (0.666667, 0.666667), 0.8: (0.5, 0.333333), 0.9: (1.0, 0.333333)}
    v = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("v"))
    b = evaluate.bootstrap_interval(v, "v", "id").first()
    assert b.mean == 4.5 and 4.0 < b.low < 4.5 < b.high < 5.0
    assert evaluate.bootstrap_interval(v.repartition(7), "v", "id").first() == b
    t = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, True), ("b", 1, False), ("c", 1, True)], "k string, t int, bad boolean")
    assert rows_of(evaluate.trailing_run(t, "k", ["t"], "bad")) == [("a", 2), ("b", 0), ("c", 1)]


def test_paragraph_chunks(spark):
    rng = random.Random(5)
    texts = ["", "  ", "short", "\n\n".join("w" * rng.randrange(1, 900) for _ in range(20)), "x" * 9000, "# h\n\nbody\n\n" + "句子。" * 2000, None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {}
    for r in chunks.paragraph_chunks(df, "id", "t").collect():
        got.setdefault(r.id, []).append((r.chunk_no, r.chunk))
    assert set(got) == {2, 3, 4, 5}
    assert all(len(c) <= 2000 for cs in got.values() for _, c in cs)
    assert got[2] == [(1, "short")] and "".join(c for _, c in sorted(got[4])).count("x") >= 9000


def test_fences_and_headings_stay_whole(spark):
    fence = "```py\nx = 1\n\n# no heading\n" + "y = 2\n" * 20 + "```"
    text = "# t\nintro\n\n" + fence + "\n\n---\n## a\nmore\n~~~\nopen"
    assert list(chunks._blocks(text)) == ["# t", "intro", fence, "---", "## a", "more", "~~~\nopen"]
    got = [r.chunk for r in chunks.paragraph_chunks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t", size=160, overlap=10).collect()]
    assert any(fence in c for c in got) and all(len(c) <= 160 for c in got)
    df = spark.createDataFrame([(1, "s"), (2, "d" * 300), (3, "h" * 1500 + "\n## x\n" + "k" * 900), (4, ("word " * 100 + "\n\n") * 40), (5, " "), (6, None)], "id long, t string")
    routes = {}
    for r in chunks.routed_chunks(df, "id", "t").collect():
        routes.setdefault((r.id, r.route), []).append(r.chunk_no)
    assert {k: len(v) for k, v in routes.items() if k[1] != "semantic"} == {(1, "aggregate"): 1, (2, "direct"): 1, (3, "headings"): 2} and len(routes[4, "semantic"]) > 5


def test_boilerplate_and_placeholders(spark):
    share = lambda t: one(spark, quality.boilerplate, t)
    assert share("好的，收到。\n我们先看日志\ntext") == pytest.approx(2 / 3) and share("a\na\na\nb") == 0.75 and share("a\na\nb") == 0 and share("") == 0 and share("谢谢你的说明") == 0
    assert share("\n".join(["x" * 41] * 5)) == 0 and share("\n".join("b a b a b".split())) == 0.6
    assert [one(spark, X.is_placeholder, t) for t in (" TODO -- ", "· — ".replace("—", "-"), "todo list", "待补", None, "- todo")] == [True, True, False, True, True, False]
    assert one(spark, lambda c: X.number_in(c, 7.0), "age 42 x") == 42.0 and one(spark, lambda c: X.number_in(c, 7.0), "none") == 7.0


def test_components_that_do_not_settle(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long"), "u", "v", most_rounds=1)


def test_gap_of_zero(spark):
    import datetime as dt

    e = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, 0, s)) for s in (0, 0, 1)], "who string, ts timestamp")
    assert sorted(r.n_events for r in sessions(e, "who", "ts", gap_seconds=0).collect()) == [1, 2]
