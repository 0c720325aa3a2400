"""Bytes of disk that queries take besides their results, against those of their table."""

import os
import random

import pytest

from corpusmill.plans import registry
from tests.test_whole_job import NOTE


def size(*folders):
    return sum(os.path.getsize(os.path.join(at, f)) for folder in folders for at, _, files in os.walk(folder) for f in files if os.path.exists(os.path.join(at, f)))


@pytest.fixture
def spent(spark, tmp_path):
    """Runs a query over notes of random words, some of them copies with changes: its rows, and its bytes of disk as a share of the table's."""

    def of(query, notes=2000, length=300):
        rng = random.Random(3)
        names, rows, text = [c.split()[0] for c in NOTE.split(", ")], [], []
        for i in range(notes):
            fresh = [f"w{rng.randrange(3000)}" for _ in range(length)]
            text = fresh if i % 4 else [a if rng.random() < 0.9 else b for a, b in zip(text or fresh, fresh, strict=True)]
            row = {"note_id": i, "author": "a", "domain": "d", "body": " ".join(text), "kb_summary": " ".join(text[:12])}
            rows.append(tuple(row.get(c) for c in names))
        spark.createDataFrame(rows, NOTE).write.parquet(f"{tmp_path}/note_record.parquet")
        java = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        folders = [*java, spark.conf.get("spark.checkpoint.dir")]
        spark._jvm.System.gc()
        before = size(*folders)
        found = registry.QUERIES[query](spark, str(tmp_path)).collect()
        return found, (size(*folders) - before) / size(f"{tmp_path}/note_record.parquet")

    return of


@pytest.mark.parametrize("query", ["cosine_pairs", "link_gate", "related_band", "triage_score"])
def test_alike_notes_take_little_disk(spent, query):
    found, share = spent(query)
    assert len(found) >= 300 and share < 4


@pytest.mark.parametrize("query", ["importance_bumps", "knn_notes", "summary_hits"])
def test_nearest_notes_take_little_disk(spent, query):
    found, share = spent(query)
    assert len(found) >= 8 and share < 2
