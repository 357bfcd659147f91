"""Sharding by size-tiered compaction, in DataFrame operations only.

Arrivals are appended as small immutable shards.  Shards of one size tier (a power of ``fanout`` times ``base``
bytes) that follow one another are merged ``fanout`` at a time; those of the last tier are merged as soon as
they fill the target size.  Merging stays within blocks of ``BLOCK`` shard numbers, so that no task sorts all
shards.  The plan works on shard sizes alone, so a row is rewritten once however many tiers its shard climbs.

A version is a small file that names a manifest of all its live shards.  It is put in place in one step that
fails if the file exists, so of two writers one commits and the other gets :class:`Conflict`.  Replaced shards
stay until ``expire`` is called, so that older versions remain whole for their readers.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, side_join

ARRIVAL_ROWS, BASE, FANOUT, TARGET = 256, 1 << 18, 4, 1 << 26
BLOCK = 4096
#: The most tasks of a write.
TASKS = 20_000


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def tier(size: Column, base: int, fanout: int, target: int) -> Column:
    """0 below base * fanout, then one more for each power of fanout, up to the tier of the target."""
    out, bound = F.lit(0), base * fanout
    while bound <= target:
        out = out + (size >= bound).cast("int")
        bound *= fanout
    return out


def tier_of(size: int, base: int, fanout: int, target: int) -> int:
    """The tier of one size."""
    out, bound = 0, base * fanout
    while bound <= target:
        out, bound = out + (size >= bound), bound * fanout
    return out


def merge_once(shards: DataFrame, base: int, fanout: int, target: int, block: int = BLOCK) -> DataFrame:
    """``shards(shard, size)`` → (shard, into): runs of ``fanout`` shards of a tier and block, or of the target size in the last tier, get the id of their first."""
    top = int(tier_of(target - 1, base, fanout, target))
    small = shards.where(F.col("size") < target).withColumns({"tier": tier(F.col("size"), base, fanout, target), "block": F.floor(F.col("shard") / block)})
    order = W.partitionBy("tier", "block").orderBy("shard")
    place = (F.row_number().over(order) - 1).cast("bigint")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    runs = small.withColumn("run", F.when(F.col("tier") == top, F.floor(before / target)).otherwise(F.floor(place / fanout)))
    full = F.when(F.col("tier") == top, (F.col("n") > 1) & (F.col("all") >= target)).otherwise(F.col("n") == fanout)
    first = runs.groupBy("tier", "block", "run").agg(F.min("shard").alias("into"), F.count("*").alias("n"), F.sum("size").alias("all")).where(full)
    return runs.join(first, ["tier", "block", "run"]).select("shard", "into")


class ShardStore:
    """A folder of shards with versioned manifests."""

    def __init__(self, spark: SparkSession, root: str, base: int = BASE, fanout: int = FANOUT, target: int = TARGET):
        self.spark, self.root, self.base, self.fanout, self.target = spark, root, base, fanout, target
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _named(self, version: int) -> str:
        return f"{self.root}/versions/v{version:08d}"

    def _list(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def version(self) -> int:
        """The last committed version; 0 if there is none."""
        return max((int(n[1:]) for n in self._list("versions") if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, shard, size, rows of the live shards."""
        version = self.version() if version is None else version
        schema = "run string, shard bigint, size bigint, rows bigint"
        if not version:
            return self.spark.createDataFrame([], schema)
        name = self.spark.read.text(self._named(version)).first()[0]
        return self.spark.read.schema(schema).parquet(f"{self.root}/manifests/{name}")

    def _claim(self, temporary: str, final: str) -> bool:
        """Move a file to a name that isn't taken, in one step.  A rename to a taken name fails on distributed
        file systems but not on a local one, where a hard link does."""
        if self._fs.getScheme() != "file":
            return self._fs.rename(self._path(temporary), self._path(final))
        local = lambda p: self._jvm.java.io.File(self._path(p).toUri().getPath()).toPath()
        try:
            self._jvm.java.nio.file.Files.createLink(local(final), local(temporary))
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def commit(self, manifest: DataFrame, after: int) -> int:
        """Write ``manifest`` as the version after ``after``, or raise Conflict."""
        name = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/manifests/{name}")
        temporary = f"{self.root}/versions/.new-{name}"
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        out = self._fs.create(self._path(temporary), False)
        out.write(bytearray(name.encode()))
        out.close()
        won = self._claim(temporary, self._named(after + 1))
        self._fs.delete(self._path(temporary), False)
        if not won:
            self._fs.delete(self._path(f"{self.root}/manifests/{name}"), True)
            raise Conflict(f"version {after + 1} exists")
        return after + 1

    def append(self, rows: DataFrame, size: Column) -> int:
        """Add ``rows`` with a bigint column ``shard``, one new immutable shard for each value."""
        before, run = self.version(), uuid.uuid4().hex
        new = rows.groupBy("shard").agg(F.sum(size).cast("bigint").alias("size"), F.count("*").alias("rows"), F.lit(run).alias("run"))
        made = f"{self.root}/manifests/{run}"
        new.write.parquet(made)
        new = self.spark.read.schema("shard bigint, size bigint, rows bigint, run string").parquet(made)
        self._write(rows, run, new.count())
        version = self.commit(self.manifest(before).unionByName(new), before)
        self._fs.delete(self._path(made), True)
        return version

    def _write(self, rows: DataFrame, run: str, shards: int) -> None:
        """A task for each shard, so that none holds more than a few shards."""
        rows.repartition(max(1, min(shards, TASKS)), "shard").write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.root}/data/run={run}")

    def read(self, version: int | None = None) -> DataFrame:
        """All live rows of a version, with run, shard, size and rows of their shard.  Only the runs it names are listed."""
        live = self.manifest(version)
        runs = [f"{self.root}/data/run={r.run}" for r in live.select("run").distinct().collect()]  # one for each append or compaction
        if not runs:
            raise ValueError("the store is empty")
        data = self.spark.read.option("basePath", f"{self.root}/data").parquet(*runs)
        return side_join(data.withColumn("shard", F.col("shard").cast("bigint")), live, ["run", "shard"])

    def plan(self, scratch: Scratch) -> DataFrame:
        """shard → into, for the shards to merge.  Works on the manifest only, in one round for each tier."""
        now = self.manifest().select("shard", "size", F.col("shard").alias("into"))
        now, k = scratch.table(now, "plan0"), 0
        while True:
            shards = now.groupBy("into").agg(F.sum("size").cast("bigint").alias("size")).withColumnRenamed("into", "shard")
            step = scratch.table(merge_once(shards, self.base, self.fanout, self.target), f"step{k}")
            if step.isEmpty():
                return now
            moved = now.join(step.select(F.col("shard").alias("into"), F.col("into").alias("next")), "into", "left")
            k += 1
            now = scratch.table(moved.select("shard", "size", F.coalesce("next", "into").alias("into")), f"plan{k}")

    def compact(self, scratch: Scratch) -> int:
        """Merge what the plan says and commit the new manifest; the shards it replaces stay until ``expire``."""
        before, run = self.version(), uuid.uuid4().hex
        plan, old = self.plan(scratch), self.manifest(before)
        joined = plan.groupBy("into").agg(F.count("*").alias("n")).where("n > 1").select("into")
        moves = scratch.table(plan.join(joined, "into").select("shard", "into"), "moves")
        merges = moves.select("into").distinct().count()
        if not merges:
            return before
        rows = side_join(self.read(before).drop("run", "size", "rows"), moves, "shard").drop("shard").withColumnRenamed("into", "shard")
        self._write(rows, run, merges)
        merged = old.join(moves, "shard").groupBy("into").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows"))
        merged = merged.select(F.lit(run).alias("run"), F.col("into").alias("shard"), "size", "rows")
        return self.commit(old.join(moves, "shard", "left_anti").select("run", "shard", "size", "rows").unionByName(merged), before)

    def expire(self, keep: int = 2) -> list[str]:
        """Delete all versions but the last ``keep``, and the runs that no kept version names; returns those runs.

        A run whose commit is still under way isn't named by any version: call this when no writer is at work.
        """
        last = self.version()
        kept = range(max(1, last - keep + 1), last + 1)
        named = {r.run for v in kept for r in self.manifest(v).select("run").distinct().collect()}
        names = {self.spark.read.text(self._named(v)).first()[0] for v in kept}
        gone = sorted(n.removeprefix("run=") for n in self._list("data") if n.startswith("run=") and n.removeprefix("run=") not in named)
        for v in (int(n[1:]) for n in self._list("versions") if n.startswith("v")):
            if v < kept.start:
                self._fs.delete(self._path(self._named(v)), False)
        for path in [f"data/run={r}" for r in gone] + [f"manifests/{n}" for n in self._list("manifests") if n not in names]:
            self._fs.delete(self._path(f"{self.root}/{path}"), True)
        return gone


def shard(docs: DataFrame, scratch: Scratch, arrival_rows: int = ARRIVAL_ROWS, base: int = BASE, fanout: int = FANOUT, target: int = TARGET) -> DataFrame:
    """Append ``docs(doc_id, text)`` in arrivals, compact them and read the live shards back.

    One row per row: doc_id, arrival, shard_id (first arrival of its shard), shard_rows, shard_bytes,
    text_sha256.  An arrival holds the doc_ids of one range of ``arrival_rows``; a null doc_id belongs to
    arrival 0.  The size of a row is 8 bytes and its text's; null text stays null with a null digest.
    Repeated doc_ids are kept; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0))
    arrival = F.floor((key - F.pmod(key, F.lit(arrival_rows))) / arrival_rows).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", arrival.alias("arrival"), arrival.alias("shard"))
    out = "doc_id bigint, arrival bigint, shard_id bigint, shard_rows bigint, shard_bytes bigint, text_sha256 string"
    if rows.isEmpty():
        return spark.createDataFrame([], out)
    store = ShardStore(spark, scratch.path("store"), base, fanout, target)
    store.append(rows, F.lit(8) + F.coalesce(F.octet_length("text"), F.lit(0)))
    store.compact(scratch)
    return store.read().select("doc_id", "arrival", F.col("shard").alias("shard_id"), F.col("rows").alias("shard_rows"), F.col("size").alias("shard_bytes"), F.sha2("text", 256).alias("text_sha256"))


def sql(rounds: int = 12, arrival_rows: int = ARRIVAL_ROWS, base: int = BASE, fanout: int = FANOUT, target: int = TARGET) -> str:
    """The query in DuckDB SQL; ``rounds`` of merging suffice for fanout ** rounds arrivals."""
    bounds, bound = [], base * fanout
    while bound <= target:
        bounds.append(bound)
        bound *= fanout
    level = " + ".join(["0", *(f"CAST(size >= {b} AS INTEGER)" for b in bounds)])
    top = tier_of(target - 1, base, fanout, target)
    order = "OVER (PARTITION BY t, b ORDER BY s)"
    out = f"""
WITH d AS (SELECT doc_id, text, (coalesce(doc_id, 0) - (coalesce(doc_id, 0) % {arrival_rows})) // {arrival_rows} AS arrival, 8 + coalesce(strlen(text), 0) AS size FROM documents),
p0 AS (SELECT arrival, sum(size) AS size, arrival AS s FROM d GROUP BY arrival)"""
    for k in range(rounds):
        out += f""",
s{k} AS (SELECT s, sum(size) AS size FROM p{k} GROUP BY s),
t{k} AS (
  SELECT s, t, b, size, CASE WHEN t = {top} THEN (sum(size) {order} - size) // {target} ELSE (row_number() {order} - 1) // {fanout} END AS run
  FROM (SELECT s, size, {level} AS t, s // {BLOCK} AS b FROM s{k} WHERE size < {target})),
m{k} AS (SELECT t, b, run, min(s) AS first FROM t{k} GROUP BY t, b, run HAVING CASE WHEN t = {top} THEN count(*) > 1 AND sum(size) >= {target} ELSE count(*) = {fanout} END),
p{k + 1} AS (SELECT arrival, size, coalesce(first, p{k}.s) AS s FROM p{k} LEFT JOIN (SELECT s, first FROM t{k} JOIN m{k} USING (t, b, run)) j USING (s))"""
    return (
        out
        + f"""
SELECT doc_id, arrival, s AS shard_id, n AS shard_rows, b AS shard_bytes, sha256(text) AS text_sha256
FROM d JOIN p{rounds} USING (arrival) JOIN (SELECT s, count(*) AS n, CAST(sum(d.size) AS BIGINT) AS b FROM d JOIN p{rounds} USING (arrival) GROUP BY s) USING (s)
"""
    )
