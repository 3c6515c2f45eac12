"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of (dimension, integer weight). Candidates are cut into blocks, each stored as an inverted
index: per dimension the positions and weights of its non-zero entries. A block of query rows meets each candidate
block once: dimension after dimension, the weighted postings are scattered into dense score arrays; partition
selection keeps k of a block, and the k best of all blocks are merged.

Query blocks are dealt to candidate blocks by a key, so nothing is broadcast and no task holds more than one pair of
blocks. The work is (queries x candidates), as the exact search asks.

Nulls: a vector that is null, or holds a null, NaN or infinite component, takes no part, neither as query nor as
candidate; so do rows with a null id. Vectors of unlike length are compared over their common dimensions. Ties go to
the smaller id. Repeated rows (same id, same vector) count once. A query never meets rows of its own id. Weights and
scores are 64-bit integers and wrap around beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.llm.common import materialize


def quantize(vectors: DataFrame, scale: float, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, w ARRAY<BIGINT>): floor(scale * x) of each finite vector."""
    x = F.col(vector)
    ok = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(math.inf)))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("w")).distinct()


def _pack(kind: str):
    """Rows (block, id, w) of one block -> one row: ids and a dense little-endian int64 matrix."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = table.column("w").combine_chunks()
        length = np.diff(rows.offsets.to_numpy())
        dims = int(length.max(initial=0))
        m = np.zeros((len(ids), dims), np.int64)
        at = np.repeat(np.arange(len(ids)), length)
        m[at, np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)] = rows.flatten().to_numpy(zero_copy_only=False)
        m = m[order]
        small = np.int64 if np.abs(m).max(initial=0) >= 32768 else np.int16
        return pa.table({"block": table.column("block").slice(0, 1), "ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), "m": pa.array([m.astype(small).tobytes()], pa.binary()), "dims": pa.array([dims], pa.int32())})

    return run


def _matrix(ids: bytes, m: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.frombuffer(ids, "<i8")
    kind = np.int16 if dims and len(m) == 2 * len(key) * dims else np.int64
    return key, np.frombuffer(m, kind).reshape(len(key), dims).astype(np.int64)


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of the k best of one block; c_ids ascend."""
    dims = min(q.shape[1], c.shape[1])
    bound = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * dims
    kind = np.int32 if bound < 2**31 else np.int64
    n = len(c_ids)
    postings = []
    for d in range(dims):
        at = np.flatnonzero(c[:, d])
        # a term that a quarter of the block holds is added as a whole row, zeros included
        postings.append((None, c[:, d].astype(kind)) if 4 * len(at) >= n else (at, c[at, d].astype(kind)))
    outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 16) // max(1, n))  # the score arrays stay in the cache
    scores, term = np.empty((step, n), kind), np.empty((step, n), kind)
    for at in range(0, len(q_ids), step):
        qs, qi = q[at : at + step].astype(kind), q_ids[at : at + step]
        s, t = scores[: len(qi)], term[: len(qi)]
        s[:] = 0
        for d, (pos, weight) in enumerate(postings):
            if not len(weight):
                continue
            rows = np.flatnonzero(qs[:, d])
            if pos is None and 2 * len(rows) >= len(qi):
                np.multiply(qs[:, d, None], weight[None, :], out=t)
                s += t
            elif pos is None:
                s[rows] += qs[rows, d, None] * weight[None, :]
            else:
                s[np.ix_(rows, pos)] += qs[rows, d, None] * weight[None, :]
        keep = min(n, k + 1 if n > k else n)
        # one row of the query's id at most is dropped below, if ids are distinct; more if they repeat
        own = qi[:, None] == c_ids[None, :]
        worst = np.iinfo(kind).min
        s[own] = worst
        if keep < n:
            kth = np.partition(s, n - k, axis=1)[:, n - k]
        else:
            kth = np.full(len(qi), worst, kind)
        r, p = np.nonzero((s >= kth[:, None]) & ~own)
        order = np.lexsort((c_ids[p], -s[r, p].astype(np.int64), r))
        r, p = r[order], p[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        r, p = r[place < k], p[place < k]
        outs.append((qi[r], c_ids[p], s[r, p].astype(np.int64)))
    if not outs:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    a, b, e = (np.concatenate(x) for x in zip(*outs, strict=True))
    return a, b, e


def top_k(spark: SparkSession, vectors: DataFrame, *, k: int = 20, scale: float = 64.0, every: int = 20, query_rows: int = 512, candidate_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: for each id divisible by ``every``, its k best of all other rows."""
    w = materialize(spark, quantize(vectors, scale), "vectors")
    n = w.count()
    c_blocks, q_blocks = max(1, math.ceil(n / candidate_rows)), max(1, math.ceil(n / every / query_rows))
    shape = "block long, ids binary, m binary, dims int"
    cand = w.withColumn("block", F.pmod(F.xxhash64(F.col("id")), F.lit(c_blocks))).groupBy("block").applyInArrow(_pack("c"), shape)
    query = w.where(F.pmod(F.col("id"), F.lit(every)) == 0).withColumn("block", F.pmod(F.xxhash64(F.lit(1), F.col("id")), F.lit(q_blocks))).groupBy("block").applyInArrow(_pack("q"), shape)
    dealt = query.select(F.col("ids").alias("q_ids"), F.col("m").alias("q_m"), F.col("dims").alias("q_dims"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("block"))
    pairs = dealt.join(cand, "block").select("q_ids", "q_m", "q_dims", "ids", "m", "dims")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q_m, q_dims, ids, m, dims = (batch.column(j)[i].as_py() for j in range(6))
                a, b, s = search_block(*_matrix(q_ids, q_m, q_dims), *_matrix(ids, m, dims), k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
