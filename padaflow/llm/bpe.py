"""Byte-level BPE by overlapping chunks.

A text longer than ``chunk`` characters is cut into chunks that overlap their right neighbour.
Chunks are pre-tokenised in parallel, each from its own start.  A pre-token depends on nothing
before it, so from the first position that is a boundary in both of two neighbours on, both agree
with the whole text.  The left one is cut there and the right one starts there; a chunk that never
meets its left neighbour is joined to it.  The pieces are then encoded, and the ids of a text are
hashed in order.  Decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, arrow_map, small_batches

CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Equal to the public pattern wherever no two white-space characters meet, and needs no lookahead.
SIMPLE = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
_two_spaces = regex.compile(r"\s\s").search


class Bpe:
    """The encoder of one rank file, and the bytes of its ids."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.simple = tiktoken.Encoding("simple", pat_str=SIMPLE, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, text: str) -> list[int]:
        return (self.full if _two_spaces(text) else self.simple).encode_ordinary(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    return Bpe(path, pattern)


def boundaries(text: str, pattern: regex.Pattern) -> list[int]:
    """Starts of the pre-tokens, and the end."""
    return [m.start() for m in pattern.finditer(text)] + [len(text)]


def _edges(pattern: str, chunk: int, overlap: int):
    """Boundaries of a chunk within its first ``overlap`` characters and within those after ``chunk``."""

    def make():
        pat = regex.compile(pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            head, tail = [], []
            for text, n, last in zip(batch.column("text").to_pylist(), batch.column("n").to_pylist(), batch.column("last").to_pylist(), strict=True):
                at = boundaries(text, pat)
                inner = at if n == last else at[:-2]  # the end of the chunk may have cut the last pre-token
                head.append([x for x in at[:-2] if x < overlap] if n else [0])
                tail.append([x - chunk for x in inner if x >= chunk])
            return pa.record_batch([batch.column("uid"), batch.column("n"), pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], names=["uid", "n", "head", "tail"])

        return step

    return make


def _encode(path: str, pattern: str):
    def make():
        coder = bpe(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, ids_hash, text_hash = [], [], []
            for text in batch.column("text").to_pylist():
                ids = coder.encode(text or "")
                count.append(len(ids))
                ids_hash.append(hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            return pa.record_batch([batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    return make


def _encode_pieces(path: str, pattern: str):
    def make():
        coder = bpe(path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.array(coder.encode(x), dtype="<u4").tobytes() for x in batch.column("piece").to_pylist()]
            return pa.record_batch([batch.column(c) for c in ("uid", "doc_id", "n")] + [pa.array(ids, pa.binary())], names=["uid", "doc_id", "n", "ids"])

        return step

    return make


def _digest(path: str, pattern: str):
    """Hash the pieces of each text as they stream by, sorted by text and position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        uid, doc, n, a, b = None, None, 0, hashlib.sha256(), hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([doc], pa.int64()), pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([b.hexdigest()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        for batch in batches:
            for u, d, ids in zip(batch.column("uid").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if u != uid:
                    if uid is not None:
                        yield row()
                    uid, doc, n, a, b = u, d, 0, hashlib.sha256(), hashlib.sha256()
                n += len(ids) // 4
                a.update(ids)
                b.update(coder.decode(np.frombuffer(ids, dtype="<u4").tolist()))
        if uid is not None:
            yield row()

    return run


def _pieces(docs: DataFrame, scratch: Scratch, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Long ``docs(doc_id, text)`` as pieces between pre-token boundaries: uid, doc_id, n, piece."""
    long = docs.withColumn("uid", F.monotonically_increasing_id()).withColumn("last", F.expr(f"int((length(text) - 1) div {chunk})"))
    cut = long.select("uid", "doc_id", "last", F.posexplode(F.expr(f"transform(sequence(0, last), i -> substring(text, i * {chunk} + 1, {chunk + overlap}))")).alias("n", "text"))
    cut = scratch.table(cut.repartition("uid", "n"), "chunks")
    edges = scratch.table(arrow_map(cut.select("uid", "n", "last", "text"), _edges(pattern, chunk, overlap), "uid bigint, n int, head array<int>, tail array<int>"), "edges")
    in_text = W.partitionBy("uid").orderBy("n")  # of boundaries near the cuts, not of text
    meet = F.array_min(F.array_intersect("head", F.lag("tail").over(in_text)))
    starts = edges.select("uid", "n", F.when(F.col("n") == 0, 0).otherwise(meet).alias("start"))
    starts = starts.select("uid", "n", "start", F.sum(F.col("start").isNotNull().cast("int")).over(in_text).alias("run"))
    ends = starts.where("start IS NOT NULL").select("uid", (F.col("run") - 1).alias("run"), F.col("start").alias("end")).where("run > 0")
    whole = cut.join(starts, ["uid", "n"]).join(ends, ["uid", "run"], "left")
    # A run is one chunk, or several that never met; only those are put together.
    runs = whole.groupBy("uid", "doc_id", "run").agg(F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts"), F.max("start").alias("start"), F.max("end").alias("end"))
    cores = F.expr(f"concat_ws('', transform(parts, (p, i) -> if(i + 1 < size(parts), substring(p.text, 1, {chunk}), p.text)))")
    text = runs.select("uid", "doc_id", "run", "start", "end", cores.alias("text"), (F.size("parts") * chunk).alias("core"))
    stop = F.coalesce(F.col("core") + F.col("end"), F.length("text"))
    return text.select("uid", "doc_id", F.col("run").alias("n"), F.col("text").substr(F.col("start") + 1, stop - F.col("start")).alias("piece"))


def bpe_digests(docs: DataFrame, scratch: Scratch, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded
    bytes.  Null text counts as empty and has no ids; null and repeated doc_ids are kept as they are;
    other columns are ignored.  ``path`` must exist on every executor.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    short = arrow_map(docs.where(F.length("text") <= chunk), _encode(path, pattern), schema)
    pieces = _pieces(docs.where(F.length("text") > chunk), scratch, pattern, chunk, overlap)
    ids = arrow_map(pieces, _encode_pieces(path, pattern), "uid bigint, doc_id bigint, n bigint, ids binary")
    long = ids.repartition("uid").sortWithinPartitions("uid", "n").mapInArrow(_digest(path, pattern), schema)
    return short.union(long)
