import numpy as np
import pytest
from plain import SF
from pyspark.sql import functions as F

from lantern.llm import nearest as N
from lantern.llm.queries import op12_nearest

SCHEMA = "vec_id long, embedding array<float>, rank string"


def plain(rows, every, k=10):
    """id -> the k nearest (distance, id), distances summed in order of dimension."""
    ids, vecs = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for i in ids[ids % every == 0].tolist():
        apart = np.zeros(len(ids))
        for c in range(vecs.shape[1]):
            apart += (vecs[ids == i][0, c] - vecs[:, c]) ** 2
        out[i] = [(float(np.sqrt(apart[j])), int(ids[j])) for j in np.lexsort((ids, apart)) if ids[j] != i][:k]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_and_exact_scores_on_the_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = lists(op12_nearest(spark, sf)), plain(rows, 100)
    assert set(got) == set(want) and all(len(got[q]) == 10 for q in want)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)  # equal distances to the last bit
    assert hits >= 0.9 * 10 * len(want)


def test_clustered_vectors_copies_and_small_cells(spark, monkeypatch):
    """Clusters are found whole, a vector shared by a third of the rows costs nothing, and
    buckets fall into many cells."""
    monkeypatch.setattr(N, "CELL_ROWS", 16)
    monkeypatch.setattr(N, "CELL_QUERIES", 4)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 24))
    rows = [(i, (centres[0] if i % 3 == 0 else centres[i % 8] + rng.standard_normal(24) * 0.2).astype(np.float32).tolist()) for i in range(600)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    got, want = lists(N.nearest(df, F.col("id") % 10 == 0)), plain(rows, 10)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert set(got) == set(want) and hits >= 0.95 * 10 * len(want)
    for q in want:  # copies: distance 0, smallest ids first
        if q % 3 == 0:
            assert got[q] == want[q]


def test_awkward_rows(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]),
            (6, []), (None, [1.0, 0.0]), (7, [1.0]), (8, [-1.0, -0.0, 0.0]), (9, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = lists(N.nearest(df, F.col("id") % 100 == 0))
    assert got == {0: [(0.0, 7), (0.5, 1), (2.0, 8), (2.0, 9)]}
    assert lists(N.nearest(df.limit(0), F.col("id") % 100 == 0)) == {}
    assert lists(N.nearest(df.where("vec_id = 0"), F.col("id") == 0)) == {}


def test_turns_keep_lengths_and_chances_are_a_distribution():
    turns = N.Turns(24)
    unit = N.unit_rows(np.random.default_rng(0).standard_normal((50, 24)))
    for t in range(N.TABLES):
        assert np.allclose(np.linalg.norm(turns(unit, t), axis=1), 1)
    turned = [turns(unit, t)[0] for t in range(N.TABLES)]
    near, far = (N.chances(turned[0], turns.noise, c) for c in (0.95, 0.0))
    assert near.sum() == pytest.approx(1) and near.argmax() == N.axes(turns(unit, 0))[0] and near.max() > far.max()
    looks = {c: N._outwards([N.signed(x) for x in turned], [N.chances(x, turns.noise, c) for x in turned], 0.95) for c in (0.99, 0.3, -1.0)}
    assert len(looks[0.99]) < len(looks[0.3]) < len(looks[-1.0])
    assert looks[0.3][:len(looks[0.99])] == looks[0.99]  # outwards from the query, however far
