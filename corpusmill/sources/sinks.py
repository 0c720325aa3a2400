"""Writers: versioned tables, ledgers, merged fields, evidence and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import is_written


def save_versioned(tables: dict[str, DataFrame], folder: str, version: int) -> str:
    """Writes ``tables`` below a new name in ``folder`` and then, in one step, the row of ``current`` that points to it; readers see the old tables or the new ones."""
    name = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for key, df in tables.items():
        df.write.parquet(f"{folder}/{name}/{key}")
    row = spark.createDataFrame([(name, version)], "name string, version int").withColumn("at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return name


def load_versioned(spark: SparkSession, folder: str, keys: list[str], version: int) -> dict[str, DataFrame] | None:
    """The newest tables of ``folder``; None where there are none or the newest have another version."""
    if not is_written(spark, f"{folder}/current"):
        return None
    row = spark.read.parquet(f"{folder}/current").orderBy(F.desc("at")).first()
    if row is None or row.version != version:
        return None
    return {k: spark.read.parquet(f"{folder}/{row.name}/{k}") for k in keys}


def append_ledger(rows: DataFrame, path: str) -> None:
    """Adds ``rows`` to a ledger of JSON lines."""
    rows.write.mode("append").json(path)


def upserted(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``changes`` replaced where ``changes`` has a row of the key and the value isn't null; keys only there are added."""
    shared = [c for c in rows.columns if c != key and c in changes.columns]
    j = rows.alias("r").join(changes.alias("c"), F.col(f"r.{key}") == F.col(f"c.{key}"), "full")
    return j.select(F.coalesce(f"r.{key}", f"c.{key}").alias(key), *(F.coalesce(f"c.{c}", f"r.{c}").alias(c) if c in shared else F.col(f"r.{c}") for c in rows.columns if c != key))


def new_evidence(incoming: DataFrame, stored: DataFrame, domain: str, body: str, slug: str) -> DataFrame:
    """Rows of ``incoming`` whose stripped body isn't stored in their domain, once each, with ``sha`` and a free ``name``.

    Of equal bodies the smallest slug stays; a slug that is taken gets the next free number. ``stored`` has ``domain, sha, name``.
    """
    rows = incoming.withColumn("sha", F.sha2(F.regexp_replace(F.col(body), r"^\s+|\s+$", ""), 256)).where("sha is not null")
    rows = rows.join(stored.select(F.col(domain), "sha"), [domain, "sha"], "left_anti")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(domain, "sha").orderBy(slug))).where("_r = 1").drop("_r")
    taken = stored.select(F.regexp_replace("name", r"-\d+$", "").alias("_base"), F.coalesce(F.regexp_extract("name", r"-(\d+)$", 1).try_cast("int"), F.lit(1)).alias("_k")).groupBy("_base").agg(F.max("_k").alias("_top"))
    rows = rows.join(taken, F.col(slug) == F.col("_base"), "left")
    n = F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy(slug).orderBy("sha"))
    return rows.withColumn("name", F.when(n == 1, F.col(slug)).otherwise(F.concat(F.col(slug), F.lit("-"), n.cast("string")))).drop("_base", "_top")


def mermaid(nodes: DataFrame, edges: DataFrame, most: int = 200) -> str:
    """A Mermaid graph of the first ``most`` nodes (``id, label``) by id and the edges (``src, dst, kind``) among them."""
    kept = nodes.orderBy("id", "label").limit(most).collect()
    named = {r.id: f"n{i}" for i, r in enumerate(kept)}
    inside = edges.where(F.col("src").isin(list(named)) & F.col("dst").isin(list(named))).distinct().orderBy("src", "dst", "kind")
    lines = ["graph LR", *(f'  {named[r.id]}["{r.label}"]' for r in kept)]
    return "\n".join([*lines, *(f"  {named[r.src]} -->|{r.kind}| {named[r.dst]}" for r in inside.collect())])
