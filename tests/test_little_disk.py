"""What joins and searches of notes leave on disk where the table is one file, and the marks that pairs are told by."""

import random

import numpy as np
import pytest

from corpusmill.operators import bags
from corpusmill.plans import registry
from corpusmill.sources.tables import shared_out
from tests.test_disk import size
from tests.test_whole_job import NOTE


@pytest.fixture
def left(spark, tmp_path):
    """Runs a query over one file of notes, of which many are alike: its rows, and its bytes of disk as a share of the file's."""

    def of(query, notes=3000, length=200):
        rng = random.Random(4)
        names, rows, text = [c.split()[0] for c in NOTE.split(", ")], [], []
        for i in range(notes):
            fresh = [f"w{rng.randrange(3000)}" for _ in range(length)]
            text = fresh if i % 60 == 0 else [a if rng.random() < 0.99 else b for a, b in zip(text, fresh, strict=True)]
            row = {"note_id": i, "author": f"a{i % 10}", "domain": "d", "body": " ".join(text), "kb_summary": " ".join(text[:12])}
            rows.append(tuple(row.get(c) for c in names))
        spark.createDataFrame(rows, NOTE).coalesce(1).write.parquet(f"{tmp_path}/note_record.parquet")
        java = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        folders = [*java, spark.conf.get("spark.checkpoint.dir")]
        spark._jvm.System.gc()
        before = size(*folders)
        found = registry.QUERIES[query](spark, str(tmp_path)).collect()
        return found, (size(*folders) - before) / size(f"{tmp_path}/note_record.parquet")

    return of


@pytest.mark.parametrize("query", ["link_gate", "related_band"])
def test_pairs_and_texts_are_neither_stored_nor_shuffled(left, query):
    found, share = left(query)
    assert len(found) >= 50 and share < 1.5


def test_rows_meet_where_they_share_a_mark(monkeypatch):
    monkeypatch.setattr(bags, "MARKS", 7)
    rng = random.Random(6)
    sides = [[[rng.randrange(25) for _ in range(rng.randrange(5))] for _ in range(20)] for _ in range(2)]
    pairs = [(i, j) for i in range(20) for j in range(20) if rng.random() < 0.7]
    p, q = ((np.cumsum([0, *map(len, x)]), np.array(sum(x, []), np.int64)) for x in sides)
    got = bags.meeting(*(np.array(x) for x in zip(*pairs, strict=True)), p, q)
    assert got.tolist() == [bool(set(sides[0][i]) & set(sides[1][j])) for i, j in pairs]
    none = np.zeros(0, np.int64)
    assert bags.meeting(none, none, p, q).tolist() == []


def test_packed_numbers_are_the_same():
    x = np.array([0, 1, 255, 256, 70_000, 2**31, 2**32 - 1])
    assert bags.unpacked(bags.packed(x)).tolist() == x.tolist() and len(bags.unpacked(bags.packed(x[:0]))) == 0


def test_one_file_is_shared_out_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("corpusmill.sources.tables.SHARE", 100)
    rows = [(i or None, f"text {i}") for i in range(300)]
    spark.createDataFrame(rows, "note_id long, body string").coalesce(1).write.parquet(f"{tmp_path}/note_record.parquet")
    df = shared_out(spark, str(tmp_path), "note_record", "note_id")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.note_id or 0, r.body) for r in df.collect()) == [(i or 0, t) for i, t in rows]


@pytest.mark.parametrize("query", ["knn_notes", "summary_hits"])
def test_searches_shuffle_no_texts(left, query):
    found, share = left(query)
    assert len(found) >= 30 and share < 3
