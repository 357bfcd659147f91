"""A compiled lexicon kept as Parquet under the hash of everything it depends on."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padaflow.operators.rules import default_rules
from padaflow.plans.compiled import fingerprint
from padaflow.plans.engine import Engine
from padaflow.sources import lexicon


def content_hash(spark: SparkSession, paths: list[str], english: bool = True, rules: str | None = None) -> str:
    """Of the names and bytes of the files in order, the rules and the flag; files are hashed by executors."""
    digests = {}
    if paths:
        rows = spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("h")).collect()
        digests = {r.path.split("/")[-1]: r.h for r in rows}
    names = [p.rstrip("/").split("/")[-1] for p in paths]
    return fingerprint([f"{n}\0{digests.get(n)}".encode() for n in names] + [(rules or default_rules()).encode()], english)


def entries_cached(spark: SparkSession, paths: list[str], root: str, english: bool = True, rules: str | None = None) -> DataFrame:
    """Merged entries of the files, written once; a folder without a complete table is rebuilt.

    The table is written under another name and renamed, so a reader never sees half of it.
    """
    final = f"{root.rstrip('/')}/lexicon-{content_hash(spark, paths, english, rules)[:24]}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(final).getFileSystem(conf)
    if not fs.exists(path(f"{final}/_SUCCESS")):
        temporary = f"{root.rstrip('/')}/.new-{uuid.uuid4().hex}"
        lexicon.entries(lexicon.read_all(spark, paths)).coalesce(1).write.parquet(temporary)
        if fs.exists(path(final)):
            fs.delete(path(final), True)
        if not fs.rename(path(temporary), path(final)):
            fs.delete(path(temporary), True)  # another writer was first, with the same content
    return spark.read.parquet(final)


def engine_cached(spark: SparkSession, paths: list[str], root: str, english: bool = True, rules: str | None = None, **filters: Any) -> Engine:
    return Engine.from_lexicon(spark, entries_cached(spark, paths, root, english, rules), english, rules, **filters)
