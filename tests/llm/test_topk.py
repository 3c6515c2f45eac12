import math

import numpy as np

from relaypack.llm import topk

SHAPE = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20, every=20):
    ok = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok[i] = [math.floor(64 * float(np.float32(x))) for x in v]
    out = []
    for q in ok:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(n, dims, seed, values=None):
    r = np.random.default_rng(seed)
    m = r.choice(values, (n, dims)) if values is not None else r.normal(size=(n, dims))
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(m)]


def test_equals_brute_force(spark):
    rows = vectors(300, 16, 1)
    df = spark.createDataFrame(rows, SHAPE)
    assert result(topk.top_k(spark, df)) == brute(rows)
    assert result(topk.top_k(spark, df, query_rows=4, candidate_rows=50)) == brute(rows)


def test_ties_sparse_rows_and_repeats(spark):
    rows = vectors(200, 8, 2, [0.0, 0.0, 0.5])
    assert result(topk.top_k(spark, spark.createDataFrame(rows + rows[:30], SHAPE), candidate_rows=64)) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, -1.0], 1), (20, [0.5, math.nan], 1), (40, [math.inf, 0.0], 1), (60, None, 1), (80, [0.1, None], 1), (100, [], 1), (None, [1.0, 1.0], 1), (1, [-0.001, 0.3], None), (-20, [3.0, 2.0], 1)]
    assert result(topk.top_k(spark, spark.createDataFrame(rows, SHAPE))) == brute(rows)
    assert topk.top_k(spark, spark.createDataFrame([], SHAPE)).collect() == []


def test_clashing_columns(spark):
    from docs import clashing

    rows = vectors(45, 4, 3)
    assert result(topk.top_k(spark, clashing(spark.createDataFrame(rows, SHAPE)))) == brute(rows)
