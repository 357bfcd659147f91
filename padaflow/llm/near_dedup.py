"""MinHash near-deduplication: one-permutation hashing, optimal densification, bands and stars.

1. Every document gets its set of word shingles, a fingerprint of the set and 96 one-permutation
   MinHash slots in 24 bands of 4.  At a similarity of 0.85 all bands of a pair differ with
   probability 2e-8.
2. Equal sets collapse to their least doc_id, so copies never meet in a bucket.
3. In each bucket the member with the most bucket mates is the hub, and every other member is one
   candidate edge to it: a bucket of n members makes n - 1 edges.
4. Edges are confirmed on full sets.  Members that differ from their hub in similar ways may be
   linked past it, so the shingles that a member adds to its hub (or, if there are none, those that it
   lacks) are sketched too; equal slots under one hub make the next layer of stars, confirmed likewise.
   Groups are the connected components of all confirmed edges so far; members of one group needn't meet
   again.  Layers end when one has no new pair of different groups, or links none of them.  Bands and slots
   set the recall.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, arrow_map, grouped, side_join, small_batches, texts
from padaflow.llm.components import components
from padaflow.llm.kernels import U, fold, mix, shingle_sets, signed

BANDS, ROWS = 24, 4
#: Slots of the sketch of what a member adds to its hub.
SECOND = 24


class OnePermutation:
    """One hash range cut into equal bins; an empty bin borrows from a bin drawn by 2-universal hashing."""

    def __init__(self, bins: int):
        self.bins = bins
        self.edges = np.array([-(-(i << 64) // bins) for i in range(bins)], dtype=U)

    def slots(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of slots for each non-empty sorted set."""
        out = np.zeros((len(sets), self.bins), dtype=U)
        full = np.zeros((len(sets), self.bins), dtype=bool)
        for i, s in enumerate(sets):
            at = np.searchsorted(s, self.edges)
            has = np.diff(at, append=len(s)) > 0
            out[i, has] = s[at[has]]
            full[i] = has
        row, col = np.nonzero(~full)
        attempt = 0
        while len(row):
            attempt += 1
            draw = mix(col.astype(U) * U(0xA0761D6478BD642F) + U(attempt * 0xE7037ED1A0B428DB % (1 << 64))) % U(self.bins)
            draw = draw.astype(np.int64)
            hit = full[row, draw]
            out[row[hit], col[hit]] = out[row[hit], draw[hit]]
            row, col = row[~hit], col[~hit]
        return out


def _signatures(width: int, bands: int, rows: int):
    def make():
        oph = OnePermutation(bands * rows)

        def step(batch: pa.RecordBatch):
            docs = texts(batch)
            for a, b in grouped([len(d) for d in docs]):
                sets = shingle_sets(docs[a:b], width)
                some = [i for i, s in enumerate(sets) if len(s)]
                slots = oph.slots([sets[i] for i in some])
                keys = np.stack([signed(fold(slots[:, k * rows : (k + 1) * rows], k + 1)) for k in range(bands)], axis=1) if some else np.empty((0, bands), np.int64)
                marks = np.zeros((b - a, 2), dtype=np.int64)
                for i in some:
                    s = sets[i]
                    marks[i] = signed(np.array([np.add.reduce(mix(s)), np.add.reduce(mix(s ^ U(0x2545F4914F6CDD1D)))], dtype=U))
                all_keys: list = [None] * (b - a)
                for j, i in enumerate(some):
                    all_keys[i] = keys[j]
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(all_keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "bands"],
                )

        return step

    return make


def _sets(width: int):
    def make():
        def step(batch: pa.RecordBatch):
            docs = texts(batch)
            for a, b in grouped([len(d) for d in docs]):
                sets = shingle_sets(docs[a:b], width)
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s"])

        return step

    return make


def _confirm(percent: int, second: int):
    """Compare the sets of x and y; sketch what x adds to y, or what it lacks if it adds nothing."""

    def make():
        oph = OnePermutation(second)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            linked: list[bool] = []
            parts: list[np.ndarray] = []
            at: list[int] = []
            seeds: list[int] = []
            for i, (p, q) in enumerate(zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist(), strict=True)):
                x, y = np.frombuffer(p, dtype=U), np.frombuffer(q, dtype=U)
                common = y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x
                n = int(common.sum())
                linked.append(100 * n >= percent * (len(x) + len(y) - n))
                if n < len(x):
                    parts.append(x[~common])
                else:
                    parts.append(y[x[np.minimum(np.searchsorted(x, y), len(x) - 1)] != y])
                if len(parts[-1]):
                    at.append(i)
                    seeds.append(int(n == len(x)))
                else:
                    parts.pop()
            keys: list[list[int]] = [[] for _ in linked]
            if parts:
                hub = batch.column("y").to_numpy()[at].astype(np.int64).view(U)
                slots = oph.slots(parts) ^ np.array(seeds, dtype=U)[:, None]
                own = signed(np.stack([fold(np.stack([hub, slots[:, k]], axis=1), 1000 + k) for k in range(second)], axis=1))
                for i, k in zip(at, own.tolist(), strict=True):
                    keys[i] = k
            return pa.record_batch([batch.column("x"), batch.column("y"), pa.array(linked, pa.bool_()), pa.array(keys, pa.list_(pa.int64()))], names=["x", "y", "linked", "keys"])

        return step

    return make


def _stars(members: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """``members(key, x, root)`` → candidate edges ``(x, y)`` between groups, y being the hub of a bucket of x.

    Members of one group (of one root) are linked already.  The hub is the member with the most bucket mates
    (ties: least id).
    """
    full = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "n")
    shared = scratch.table(members.join(full, "key").select("key", "x", "root", "n"), f"{tag}_shared")
    mates = shared.groupBy("x").agg(F.sum(F.col("n") - 1).alias("mates"))
    ranked = shared.join(mates, "x")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("mates", (-F.col("x")).alias("neg"), "root")).alias("h"))
    hubs = hubs.select("key", (-F.col("h.neg")).alias("y"), F.col("h.root").alias("hub_root"))
    return shared.join(hubs, "key").where("root != hub_root").select("x", "y").distinct()


def near_dedup(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, second: int = SECOND) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but blank and \\x09-\\x0D, A-Z lower-cased; the set holds the distinct
    shingles of ``width`` words, or the whole sequence if it is shorter.  Documents are linked if
    100 * intersection >= percent * union.  component_id is the least doc_id reachable, and the row
    with it is kept.  Null and empty texts have an empty set and no link.  Rows that share a doc_id
    are one node.  A null doc_id has no links, a null component_id and is kept.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sig = scratch.table(arrow_map(docs, _signatures(width, bands, rows), "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, bands array<bigint>"), "sig")
    one = ["fp1", "fp2", "n_shingles"]
    known = sig.where("doc_id IS NOT NULL")
    reps = scratch.table(known.where("n_shingles > 0").groupBy(one).agg(F.min(F.struct("doc_id", "bands")).alias("r")).select(*one, F.col("r.doc_id").alias("rep"), F.col("r.bands").alias("bands")), "reps")

    members = reps.select(F.explode("bands").alias("key"), F.col("rep").alias("x"), F.col("rep").alias("root")).distinct()
    none = docs.sparkSession.createDataFrame([], "node bigint, root bigint")
    tried, sets, roots, level = None, None, none, 0
    while True:
        pairs = _stars(members, scratch, f"l{level}")
        pairs = scratch.table(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), f"l{level}_pairs")
        if pairs.isEmpty():
            break
        if sets is None:  # later layers only have documents of the first one's pairs
            ids = scratch.table(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "ids")
            sets = scratch.table(arrow_map(side_join(docs, ids, "doc_id", "left_semi"), _sets(width), "doc_id bigint, s binary").where("octet_length(s) > 0"), "sets")
        checked = scratch.table(_confirmed(sets, pairs, scratch, f"l{level}", percent, second), f"l{level}_checked")
        links = checked.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        if links.isEmpty():
            break
        roots = scratch.table(components(roots.toDF("a", "b").union(links), scratch, f"l{level}_cc"), f"l{level}_roots")
        both = pairs.union(pairs.select("y", "x"))
        tried = scratch.table(both if tried is None else tried.union(both), f"l{level}_tried")
        sketched = checked.select(F.explode("keys").alias("key"), "x").distinct()
        members = side_join(sketched, roots.withColumnRenamed("node", "x"), "x", "left").select("key", "x", F.coalesce("root", "x").alias("root"))
        scratch.drop(f"l{level}_shared", f"l{level}_hubs")
        level += 1

    # Copies of equal sets whose representatives are one doc_id are linked through it.
    placed = known.where("n_shingles > 0").join(reps.drop("bands"), one).select("doc_id", F.col("rep").alias("node"), "n_shingles")
    placed = placed.join(roots, "node", "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    rest = sig.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _confirmed(sets: DataFrame, pairs: DataFrame, scratch: Scratch, tag: str, percent: int, second: int) -> DataFrame:
    """Verify ``pairs(x, y)`` on full shingle sets ``sets(doc_id, s)``: x, y, linked, keys."""
    hubs = scratch.table(sets.join(pairs.select(F.col("y").alias("doc_id")).distinct(), "doc_id", "left_semi"), f"{tag}_hubs")  # a hub's set is sent once if they are small
    wide = side_join(pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x"), hubs.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y")
    return arrow_map(wide.select("x", "y", "sx", "sy"), _confirm(percent, second), "x bigint, y bigint, linked boolean, keys array<bigint>")
