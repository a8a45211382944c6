import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from plain import AWKWARD, components, shingles

from lantern.llm import near_dup as N
from lantern.llm import shingles as S
from lantern.llm.components import components as connected
from lantern.llm.queries import op8_near_dup


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = components(texts, 3, 85, 100)
    got = {r.doc_id: r for r in op8_near_dup(spark, sf).collect()}
    assert len(got) == len(want)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_a_large_group_whose_links_are_sparse(spark):
    """Copies that drift apart: few pairs reach the threshold, so leaders alone miss links."""
    rng = random.Random(2)
    base, texts = [f"w{i}" for i in range(60)], {}
    for d in range(250):
        if d % 10 == 0:
            text = list(base)
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(60)] = f"v{rng.randrange(1000)}"
        texts[d] = " ".join(text)
    want = components(texts, 3, 85, 100)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (2048, 16):  # buckets whole, and in pairs of blocks
        got = {r.id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, size=3, threshold=Fraction(85, 100), block=block).collect()}
        assert got == want
    assert 1 < len({c for _, c in want.values()}) < 250


def test_awkward_rows(awkward):
    rows = N.near_duplicates(awkward, size=3).collect()
    assert len(rows) == len(AWKWARD)
    got = {}
    for r in rows:
        got.setdefault(r.id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert got[7] == got[5] | set() or got[7] == {(1, 5, False)}
    assert got[5] == {(1, 5, True)} and got[None] == {(1, None, True)}
    for d in (3, 9, 11, 15):  # null, empty, blank
        assert got[d] == {(0, d, True)}
    assert got[13] == {(1, 13, True)} and got[14] == {(1, 14, True)}
    left = N.drop_near_duplicates(awkward, size=3)
    assert left.columns == awkward.columns
    assert sorted(r.key for r in left.collect()) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert N.near_duplicates(awkward.limit(0)).count() == 0


def test_shingles_against_plain_sets():
    texts = [t for _, t in AWKWARD] + ["a b c d", "A  b\tC\nd", "a", "a b", "b a", "a b c"]
    flat, at = S.shingle_sets(pa.array(texts), 3)
    got = [frozenset(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:])]
    want = [shingles(t, 3) for t in texts]
    assert [len(x) for x in got] == [len(x) for x in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert len(got[i] & got[j]) == len(a & b)


def test_sketches_estimate_and_parities_bound():
    rng = np.random.default_rng(1)
    for similarity in (0.5, 0.8, 0.85, 0.95):
        n = 900
        shared = round(2 * n * similarity / (1 + similarity))
        some = rng.integers(0, 1 << 63, (40, 2 * n), dtype=np.uint64)
        rows, samples, most = N.plan(0.85)
        flips = []
        for x in some:
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:shared], x[n:2 * n - shared]]))
            flat, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            sketch = S.odd_sketches(S.minhashes(flat, at, samples))
            flips.append(int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()))
            gap = len(set(a.tolist()) ^ set(b.tolist()))
            assert S.apart(*S.parities(flat, at)) <= gap
        assert abs(np.mean(flips) - S.differing_bits(similarity, samples)) < 6
        if similarity >= 0.85:
            assert max(flips) <= most


def test_parities_of_different_lengths_fold():
    rng = np.random.default_rng(2)
    big = np.unique(rng.integers(0, 1 << 63, 1100, dtype=np.uint64))
    small = big[:1000]
    flat, at = np.concatenate([big, small]), np.array([0, len(big), len(big) + len(small)])
    one, two = S.parities(flat, at)
    assert len(one) == 2 * len(two) and 0 < S.apart(one, two) <= len(big) - len(small)


def test_plan_misses_less_than_one_link_in_a_million():
    for threshold in (0.5, 0.8, 0.85, 0.95):
        rows, samples, most = N.plan(threshold)
        assert samples == rows * N.BANDS and (1 - threshold ** rows) ** N.BANDS <= 1e-6
        assert most > S.differing_bits(threshold, samples)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 3), (3, 9), (8, 7), (8, 7)]])
def test_components(spark, edges):
    got = {r.node: r.label for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(parent)}
