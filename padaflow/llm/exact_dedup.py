"""Exact deduplication by composable polynomial fingerprints.

A text is a sequence of byte chunks.  A chunk of length n has the hash sum(b_i * B**(n-1-i)) mod p;
the hash of a concatenation is H(xy) = H(x) * B**len(y) + H(y), so chunks can be hashed anywhere
and joined later.  Two primes near 2**31 and the length make the fingerprint.  Texts beyond ``LONG``
bytes are cut into pieces that are hashed as rows of their own, in any tasks, and combined by number.
Equal fingerprints are then compared chunk by chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, arrow_map, hot_join, side_join, small_batches, texts

#: Two primes below 2**31, each with the base of its polynomial.
MODULI = ((2147483647, 1103515245), (2147483629, 1566083941))
CHUNK = 1 << 16
#: Longer texts (in bytes) are hashed in pieces of PIECE characters.
LONG, PIECE = 1 << 22, 1 << 20
#: What is carried of a row, and the part of it that is a join key (never null).
CARRY, ROW = ["doc_id", "__id", "__th"], ["__id", "__th"]
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Fingerprint:
    """Hash chunks and combine them by length-shifted arithmetic."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self.weights = []
        for p, base in MODULI:
            w = np.empty(chunk, dtype=np.uint64)
            x = 1
            for i in range(chunk - 1, -1, -1):
                w[i] = x
                x = x * base % p
            self.weights.append(w)

    def of_chunk(self, data: np.ndarray) -> tuple[int, int, int]:
        """(hash 1, hash 2, length); products stay under 2**39 and their sums under 2**55."""
        n = len(data)
        wide = data.astype(np.uint64) + np.uint64(1)
        return (*(int(wide @ w[self.chunk - n :]) % p for w, (p, _) in zip(self.weights, MODULI, strict=True)), n)

    @staticmethod
    def combine(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int, int]:
        return (*((x[k] * pow(base, y[2], p) + y[k]) % p for k, (p, base) in enumerate(MODULI)), x[2] + y[2])

    def of_text(self, data: bytes) -> tuple[int, int, int]:
        view, out = np.frombuffer(data, dtype=np.uint8), (0, 0, 0)
        for i in range(0, len(data), self.chunk):
            out = self.combine(out, self.of_chunk(view[i : i + self.chunk]))
        return out


def _fingerprints(chunk: int):
    def make():
        fp = Fingerprint(chunk)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            low = [x.lower() for x in texts(batch)]  # bytes.lower() touches A-Z only
            marks = np.array([fp.of_text(x) for x in low], dtype=np.int64).reshape(-1, 3)
            return pa.record_batch(
                [*(batch.column(c) for c in CARRY), pa.array(marks[:, 0] << 31 | marks[:, 1]), pa.array(marks[:, 2]), pa.array([hashlib.sha256(x).hexdigest() for x in low], pa.string())],
                names=[*CARRY, "fp", "size", "text_sha256"],
            )

        return step

    return make


def _pieces(chunk: int):
    """Of each piece the two hashes, its length, and what it shifts the hashes before it by."""

    def make():
        fp = Fingerprint(chunk)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            marks = [fp.of_text(x) for x in texts(batch, "piece")]
            shift = [[pow(base, m[2], p) for m in marks] for p, base in MODULI]
            columns = [pa.array([m[k] for m in marks], pa.int64()) for k in range(3)] + [pa.array(x, pa.int64()) for x in shift]
            return pa.record_batch([batch.column("uid"), batch.column("n"), *columns], names=["uid", "n", "x", "y", "size", "by_x", "by_y"])

        return step

    return make


def pieces(text: Column, size: int) -> Column:
    """Numbered pieces of ``size`` characters; an empty text has one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int")))
    return F.posexplode(F.transform(starts, lambda i: F.substring(text, i * size + 1, F.lit(size)))).alias("n", "piece")


def _low() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())


def _long_marks(docs: DataFrame, scratch: Scratch, chunk: int, piece: int) -> DataFrame:
    """Row key, fp, size and text_sha256 of texts that are hashed in pieces."""
    own = scratch.table(docs.select(*CARRY, F.monotonically_increasing_id().alias("uid"), _low().alias("low")), "long")
    parts = arrow_map(own.select("uid", pieces(F.col("low"), piece)), _pieces(chunk), "uid bigint, n int, x bigint, y bigint, size bigint, by_x bigint, by_y bigint")
    joined = parts.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("n", "x", "y", "size", "by_x", "by_y"))).alias("p"))  # 48 bytes for each piece
    (p, _), (q, _) = MODULI
    none = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("x", "y", "size")))
    step = lambda a, b: F.struct(((a["x"] * b["by_x"] + b["x"]) % p).alias("x"), ((a["y"] * b["by_y"] + b["y"]) % q).alias("y"), (a["size"] + b["size"]).alias("size"))
    joined = joined.select("uid", F.aggregate("p", none, step).alias("m"))
    whole = own.select(*CARRY, "uid", F.sha2("low", 256).alias("text_sha256")).join(joined, "uid")
    return whole.select(*CARRY, F.shiftleft("m.x", 31).bitwiseOR(F.col("m.y")).alias("fp"), F.col("m.size").alias("size"), "text_sha256")


def exact_dedup(docs: DataFrame, scratch: Scratch, chunk: int = CHUNK, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z.  Null text counts as empty; empty texts
    are equal to one another.  The row with the largest doc_id stays (null is least); repeated rows
    of one doc_id count separately and share its decision.  Other columns are ignored.

    Fingerprints are grouped with map-side combining.  Texts of groups with more than one row are
    cut into chunks, and a chunk number's chunks of one group must have one least and greatest value;
    groups that fail are split by the digest of the whole text.  No text pairs are built.  Rows are told
    apart by doc_id and a hash of the text, so those of a null doc_id are compared like all others.
    """
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("bigint")
    docs = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0)).alias("__id"), F.xxhash64(doc_id.isNull(), F.col("text")).alias("__th"), "text")
    is_long = F.coalesce(F.octet_length("text") > long, F.lit(False))
    kind = "doc_id bigint, __id bigint, __th bigint, fp bigint, size bigint, text_sha256 string"
    marks = arrow_map(docs.where(~is_long), _fingerprints(chunk), kind)
    marks = scratch.table(marks.unionByName(_long_marks(docs.where(is_long), scratch, chunk, piece)), "marks")
    groups = marks.groupBy("fp", "size").agg(F.count("*").alias("group_size"))
    many = scratch.table(groups.where("group_size > 1").select("fp", "size"), "many")
    members = scratch.table(side_join(marks, many, ["fp", "size"], "left_semi").select(*ROW, "fp", "size").distinct(), "members")
    copies = side_join(docs.select(*ROW, "text"), members, ROW).select("fp", "size", _low().alias("low"))
    parts = copies.select("fp", "size", pieces(F.col("low"), chunk))
    # Equal adjacent bounds mean one value: the comparison streams through partial aggregates.
    uneven = parts.groupBy("fp", "size", "n").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least != most").select("fp", "size").distinct()
    uneven = scratch.table(uneven, "uneven").withColumn("clash", F.lit(True))
    split = side_join(marks, uneven, ["fp", "size"], "left").withColumn("part", F.when(F.col("clash"), F.col("text_sha256")).otherwise(F.lit("")))
    key = ["fp", "size", "part"]
    split = scratch.table(split, "split")
    final = scratch.table(split.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "final")
    out = hot_join(split.select(*key, "doc_id", "text_sha256"), final, key, "group_size", marks.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
