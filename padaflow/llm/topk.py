"""Exact top-k search by inner product with norm ordering and SVD-rotated partial sums.

Vectors are stored by descending length and cut into ranges, queries into blocks.  The longest vectors give
each query a floor that its k-th score reaches at least.  A range meets a block only if its greatest length
times a query's can reach that query's floor (Cauchy-Schwarz); each meeting is a group of its own, of bounded
size.  There, vectors go by descending length in parts that are skipped for a query whose k-th score so far
they can't reach.  For the rest, the coordinates are rotated to the eigenvectors of the Gram matrix, so that
the first few hold most of the length; their partial product plus the product of the residual lengths bounds
the score, and only vectors whose bound reaches the k-th score are multiplied in full, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, side_join, small_batches

K, SCALE, EVERY = 10, 1024, 100
#: log2 of the queries in a block and of the vectors in a range (least and most); vectors in a part, rotated coordinates summed first.
QUERY_BITS, RANGE_BITS, BLOCK, HEAD = 12, (12, 16), 1024, 16
SEEDS = 2048
EXACT = float(1 << 53)


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), norm2.  Vectors with a null or non-finite part go."""
    good = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)))
    out = vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers as float64, shorter ones filled up with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, values = column.value_lengths().to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _gram(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = matrix(batch.column("v"), width)
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["i", "g"])

    return run


def product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; results beyond 64 bits are clamped."""
    if x.size and q.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= EXACT:
        wide = np.array([[int(a) for a in r] for r in x], dtype=object) @ np.array([[int(a) for a in r] for r in q], dtype=object).T
        return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)
    return (x @ q.T).astype(np.int64)


class Best:
    """The k best (score, least id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids = np.zeros((n, k), dtype=np.int64)
        self.scores = np.full((n, k), np.iinfo(np.int64).min)
        self.have = np.zeros(n, dtype=np.int64)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        n = self.have[q]
        s, i = np.concatenate([self.scores[q, :n], scores]), np.concatenate([self.ids[q, :n], ids])
        order = np.lexsort((i, -s.astype(object) if len(s) and s.min() == np.iinfo(np.int64).min else -s))[: self.k]
        self.have[q] = len(order)
        self.scores[q, : len(order)], self.ids[q, : len(order)] = s[order], i[order]


def search_block(best: Best, floor: np.ndarray, qids: np.ndarray, q: np.ndarray, qrot: np.ndarray, basis: np.ndarray, ids: np.ndarray, x: np.ndarray, head: int = HEAD) -> None:
    """Offer the vectors ``x`` to all queries.  ``floor`` holds scores that the k-th best reaches at least."""
    qlen = np.sqrt((q * q).sum(axis=1))
    xlen = np.sqrt((x * x).sum(axis=1))
    slack = 1e-9 * qlen * xlen.max(initial=0) + 1e-6
    kth = np.where(best.have == best.k, best.scores[:, -1], -np.inf)
    need = np.maximum(floor, kth)
    live = np.flatnonzero(qlen * xlen.max(initial=0) + slack >= need)
    if not len(live):
        return
    xrot = x @ basis
    rest = np.sqrt(np.maximum(0, (xrot[:, head:] ** 2).sum(axis=1)))
    qrest = np.sqrt(np.maximum(0, (qrot[live, head:] ** 2).sum(axis=1)))
    bound = qrot[live, :head] @ xrot[:, :head].T + np.outer(qrest, rest) + slack[live, None]
    hit = bound >= need[live, None]
    rows, cols = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
    if not len(rows):
        return
    exact = product(q[live[rows]], x[cols])
    for r, i in enumerate(rows):
        j = live[i]
        mine = np.flatnonzero(hit[i, cols] & (ids[cols] != qids[j]) & (exact[r] >= need[j]))
        if len(mine) > best.k:  # ties at the cut are kept for the least id
            cut = np.partition(exact[r, mine], -best.k)[-best.k]
            mine = mine[exact[r, mine] >= cut]
        if len(mine):
            best.add(j, exact[r, mine], ids[cols[mine]])


def _floors(seed_ids: np.ndarray, seeds: np.ndarray, k: int):
    """Queries with their k-th best score among the seeds, if there are so many of other ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            floor = np.full(len(ids), -np.inf)
            if len(ids) and len(seeds) > k:
                score = product(matrix(batch.column("v"), seeds.shape[1]), seeds).astype(float)
                score[ids[:, None] == seed_ids[None, :]] = -np.inf
                floor = np.partition(score, -k, axis=1)[:, -k]
            yield pa.record_batch([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return run


def _search(basis: np.ndarray, k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        qids, q = queries.column("vec_id").to_numpy(), matrix(queries.column("v"), len(basis))
        ids, x = vectors.column("vec_id").to_numpy(), matrix(vectors.column("v"), len(basis))
        best, qrot, floor = Best(len(qids), k), q @ basis, queries.column("floor").to_numpy()
        order = np.argsort(-(x * x).sum(axis=1), kind="stable") if len(qids) else []
        for a in range(0, len(order), BLOCK):
            part = order[a : a + BLOCK]
            search_block(best, floor, qids, q, qrot, basis, ids[part], x[part])
        row = np.repeat(np.arange(len(qids)), best.have)
        col = np.concatenate([np.arange(n) for n in best.have]) if len(row) else row
        return pa.table([pa.array(qids[row], pa.int64()), pa.array(best.ids[row, col], pa.int64()), pa.array(best.scores[row, col], pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def topk(vectors: DataFrame, scratch: Scratch, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """The k best candidates of each query in ``vectors(vec_id, embedding)``: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows of another vec_id.  The
    score is the inner product of floor(scale * x); shorter vectors count as filled up with 0; ties go to the
    least vec_id.  Vectors that are null or hold a null or non-finite part, and null vec_ids, take no part.
    Of rows that share a vec_id each is a candidate, and the one with the greatest vector is the query.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 8192)
    base = whole(vectors.select("vec_id", "embedding"), scale)
    base = scratch.table(base, "base")
    total, parallel = base.count(), spark.sparkContext.defaultParallelism
    bits = min(RANGE_BITS[1], max(RANGE_BITS[0], (total // (4 * parallel)).bit_length()))
    parts = max(1, min(2 * parallel, total >> bits), total >> (RANGE_BITS[1] + 4))
    place = lambda b: F.shiftright(F.monotonically_increasing_id(), b)  # noqa: E731  (in a sorted partition: runs of 2**b rows)
    stored = base.repartitionByRange(parts, F.desc("norm2"), "vec_id").sortWithinPartitions(F.desc("norm2"), "vec_id")
    stored = scratch.table(stored.withColumn("r", place(bits)), "vectors")
    schema = "query_id bigint, vec_id bigint, score bigint"
    width = stored.agg(F.max(F.size("v"))).first()[0] or 1
    sums = stored.mapInArrow(_gram(width), "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()  # width ** 2 rows
    gram = np.zeros(width * width)
    gram[sums["i"].to_numpy(dtype=np.int64)] = sums["g"]
    basis = np.ascontiguousarray(np.linalg.eigh(gram.reshape(width, width))[1][:, ::-1])

    seeds = stored.orderBy(F.desc("norm2"), "vec_id").limit(SEEDS).select("vec_id", "v").toPandas()  # lower bounds only; all rows are searched
    seed_x = matrix(pa.array(seeds["v"].tolist(), pa.list_(pa.int64())), width)
    asked = stored.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.max(F.struct("v", "norm2")).alias("m")).select("vec_id", "m.v", "m.norm2")
    asked = asked.repartitionByRange(max(1, min(parallel, total // every >> QUERY_BITS)), F.desc("norm2")).sortWithinPartitions(F.desc("norm2"), "vec_id").withColumn("b", place(QUERY_BITS))
    asked = asked.mapInArrow(_floors(seeds["vec_id"].to_numpy(dtype=np.int64), seed_x, k), "vec_id bigint, v array<bigint>, norm2 double, b bigint, floor double")
    asked = scratch.table(asked, "queries")

    # A vector of length l scores at most l times the query's; 1 and a billionth make up for rounding.
    need = F.when(F.col("norm2") > 0, (F.col("floor") - F.abs("floor") * 1e-9 - 1) / F.sqrt("norm2")).otherwise(F.lit(float("-inf")))
    blocks = asked.groupBy("b").agg(F.min(need).alias("need"))
    ranges = stored.groupBy("r").agg(F.sqrt(F.max("norm2")).alias("top"))
    meet = scratch.table(blocks.join(ranges, F.col("top") * (1 + 1e-9) >= F.col("need")).select("b", "r"), "meet")  # of blocks and ranges, not of rows
    vectors = side_join(stored.select("r", "vec_id", "v"), meet, "r")
    queries = side_join(asked.select("b", "vec_id", "v", "floor"), meet, "b")
    found = vectors.groupBy("b", "r").cogroup(queries.groupBy("b", "r")).applyInArrow(_search(basis, k), schema)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
