"""Queries of the plans over small tables: nothing of the job is left out."""

import datetime as dt

import pytest

from corpusmill.plans import registry

NOTE = (
    "note_id long, rel string, title string, domain string, tags array<string>, status string, author string, content_type string, kb_layer string, kb_summary string, "
    "created date, updated date, importance double, source_tier int, mtime timestamp, recorded_at timestamp, body string")
DAY = dt.date(2025, 6, 1)


@pytest.fixture
def run(spark, tmp_path):
    def of(query, notes, terms=()):
        names = [c.split()[0] for c in NOTE.split(", ")]
        spark.createDataFrame([tuple(n.get(c) for c in names) for n in notes], NOTE).write.parquet(f"{tmp_path}/note_record.parquet")
        spark.createDataFrame(list(terms), "term_id long, kind string, term string, aliases array<string>").write.parquet(f"{tmp_path}/canon_term.parquet")
        return registry.QUERIES[query](spark, str(tmp_path)).collect()

    return of


def words(*numbers):
    return " ".join(f"w{i}" for i in numbers)


def test_contradictions_are_looked_for_in_conclusions_of_bodies(run):
    canon = {"kb_layer": " Canon", "domain": "platform", "updated": DAY}
    notes = [
        canon | {"note_id": 1, "body": f"# t\n{words(*range(50, 90))}\n## 结论\n{words(*range(10))} 已废弃\n## other\nno"},
        canon | {"note_id": 2, "updated": dt.date(2025, 1, 1), "body": f"{words(*range(10))} x y"},
        canon | {"note_id": 3, "domain": None, "body": f"## 结论与建议\n{words(*range(8))}"},
        canon | {"note_id": 4, "domain": "storage", "body": f"{words(*range(10))}"},
        canon | {"note_id": 5, "kb_layer": "page", "body": f"{words(*range(10))}"},
        canon | {"note_id": 6, "domain": " ", "body": f"{words(*range(100, 2000))} No longer"},
        canon | {"note_id": 7, "body": f"{words(*range(100, 2000))} {words(*range(3000, 3100))}"},
    ]
    found = {(r.older, r.newer): (r.jaccard, r.kind) for r in run("contradiction_pairs", notes)}
    assert set(found) == {(2, 1), (1, 3), (6, 7)}
    assert found[2, 1] == (round(10 / 17, 6), "changed")
    assert found[6, 7] == (round(1900 / 2002, 6), "same")


HITS = [
    {"note_id": 100, "kb_summary": "x" * 70 + " rare", "body": "one"},
    {"note_id": 200, "kb_summary": "  ", "body": "\n  # other words \nrest"},
    {"note_id": 300, "body": "rare"},
    {"note_id": 400, "body": "y" * 78 + " z other"},
    {"note_id": 500, "body": "\n "},
]


def test_whole_summaries_and_first_lines_are_asked(run):
    assert {tuple(r) for r in run("summary_hits", HITS)} == {(300, 1), (400, 1)}


def test_importance_is_raised_by_whole_summaries(run):
    assert [tuple(r) for r in run("importance_bumps", HITS)] == [(300, 1, 0.55, 0.05), (400, 1, 0.55, 0.05)]


def test_likeness_takes_points_of_the_triage_score(run):
    alike = words(*range(1, 21))
    notes = [
        {"note_id": 1, "body": alike},
        {"note_id": 2, "body": alike},
        {"note_id": 3, "body": f"{alike} {words(*range(300, 305))}"},
        {"note_id": 4, "body": words(*range(400, 420))},
        {"note_id": 5, "title": alike},
    ]
    scores = {r.note_id: r.score for r in run("triage_score", notes)}
    assert scores == {1: 30, 2: 30, 3: 40, 4: 55}


def test_shared_link_targets_open_the_gate(run):
    text = words(*range(20))
    notes = [
        {"note_id": 1, "author": "a", "body": f"{text} [[there#x|y]]"},
        {"note_id": 2, "author": "b", "body": f"{text} [[ there ]]"},
        {"note_id": 3, "author": "c", "body": text},
    ]
    assert [tuple(r) for r in run("link_gate", notes)] == [(1, 2, False, False, True, True)]


def test_fields_that_stand_in_the_query_count_in_the_rerank(run):
    note = {"body": "ops howto", "importance": 0.5}
    notes = [
        note | {"note_id": 1},
        note | {"note_id": 2, "domain": "", "tags": ["", None], "content_type": ""},
        note | {"note_id": 3, "domain": "Ops"},
        note | {"note_id": 4, "content_type": "howto", "tags": ["xx", None]},
        note | {"note_id": 5, "domain": "ops", "tags": ["no", "Ops"], "content_type": "chat"},
    ]
    scores = {r.doc: r.score for r in run("reranked_top10", notes, [(1, "domain", "Ops Howto", [])])}
    base = 0.4 + 0.1 + 0.05 + 0.05
    assert scores[1] == pytest.approx(base) and scores[2] == pytest.approx(base)
    assert scores[3] == pytest.approx(base + 0.08)
    # a tag adds a token to the note's text, so that the overlap is two of three
    assert scores[4] == pytest.approx(base - 0.4 / 3 + 0.06)
    assert scores[5] == pytest.approx(base - 0.4 / 3 + 0.06)
