import numpy as np
import pytest
from plain import SF
from pyspark.sql import functions as F

from lantern.llm import hard_negatives as H
from lantern.llm.queries import op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def plain(rows, every=100, k=5, scale=256):
    """The contract in Python: rows of (id, vector, label)."""
    dims = max((len(v) for _, v, _ in rows), default=0)
    q = {i: (la, [int(np.floor(scale * float(x))) for x in v] + [0] * (dims - len(v))) for i, v, la in rows}
    out = []
    for a in sorted(q):
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(q[a][1], q[b][1])), b) for b in q if b != a)
        for p_score, p in [s for s in scores if q[s[1]][0] == q[a][0]][:k]:
            fits = [s for s in scores if q[s[1]][0] != q[a][0] and 80 * -p_score <= 100 * -s[0] <= 100 * -p_score][:k]
            out += [(a, p, r, n, -p_score, -s) for r, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def result(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_whole_table_against_every_product(spark, sf):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain(rows)
    assert result(op11_hard_negatives(spark, sf)) == want and want


def test_many_blocks_slices_and_copies(spark, monkeypatch):
    """Ties, a vector that half of the rows share, blocks and slices of a few rows."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, [0.5, 0.25, 0.0, 0.125] if i % 2 else np.round(rng.standard_normal(4), 1).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(5)
    rounded = [(i, np.array(v, np.float32).tolist(), la) for i, v, la in rows]
    got = result(H.hard_negatives(df, F.col("id") % 20 == 0, anchor_slice=4))
    assert got == plain(rounded, every=20)


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, None, 1), (3, [0.9, None], 2), (4, [float("nan"), 0.0], 2),
            (5, [float("inf"), 0.0], 2), (6, [0.8, 0.0], None), (None, [0.8, 0.0], 2), (7, [0.8], 2), (8, [], 2), (9, [1e30, 0.0], 2), (10, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = result(H.hard_negatives(df, F.col("id") % 100 == 0))
    f32 = [(i, np.array(v, np.float32).tolist(), la) for i, v, la in [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (7, [0.8], 2), (8, [], 2), (10, [-1.0, 0.0], 1)]]
    assert got == plain(f32) == [(0, 1, 1, 7, 230 * 256, 204 * 256)]
    assert result(H.hard_negatives(df.limit(0), F.col("id") % 100 == 0)) == []
    assert result(H.hard_negatives(df, F.col("id") == 77)) == []


def test_bounds_shrink_the_candidates():
    rng = np.random.default_rng(1)
    q = rng.integers(-100, 100, (500, 16)).astype(np.int32)
    q[:, 3] *= 50  # one dimension decides
    block = H.Block(np.arange(500).tobytes(), np.zeros(500, np.int64).tobytes(), [np.ascontiguousarray(c).tobytes() for c in q.T])
    anchor, seen = q[7].astype(np.int64), []

    def prune(least, most):
        seen.append(len(least))
        return most >= np.partition(least, len(least) - 5)[len(least) - 5]

    rows, score = block.scan(anchor, np.arange(500), prune)
    exact = q.astype(np.int64) @ anchor
    assert seen[0] == 500 and seen[-1] < 400
    assert set(np.argsort(-exact, kind="stable")[:5]) <= set(rows) and (score == exact[rows]).all()
