import hashlib
from collections import defaultdict

from plain import SF

from lantern.llm.sharding import assign_shards


def bits(key):
    return bin(int(hashlib.md5(key.encode()).hexdigest()[:15], 16))[2:].zfill(60)


def directory(rows, limit):
    """Shards of {(bits, size): ...} by splitting one bucket after another."""
    open_, done = {"": rows}, {}
    while open_:
        prefix, some = open_.popitem()
        if sum(n for _, n in some) <= limit or len(some) == 1:
            done[prefix] = some
            continue
        for bit in "01":
            part = [r for r in some if r[0][len(prefix)] == bit]
            if part:
                open_[prefix + bit] = part
    return done


def test_whole_table_against_one_split_at_a_time(spark, documents):
    limit = 20_000
    want = directory([(bits(str(d)), len(t.encode())) for d, t in documents.items()], limit)
    want = {p: (sum(n for _, n in rows), len(rows)) for p, rows in want.items()}
    out = assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit_bytes=limit, first_bits=4).collect()
    got = defaultdict(list)
    for r in out:
        assert bits(str(r.doc_id)).startswith(r.shard) and r.depth == len(r.shard)
        got[r.shard].append(r)
    assert {p: (sum(r.n_bytes for r in rows), len(rows)) for p, rows in got.items()} == want
    assert all((r.shard_bytes, r.shard_rows) == want[r.shard] for r in out)
    assert len(want) > 16


def test_hot_key_and_identical_rows_are_split(spark):
    rows = [(1, "y" * 100 + str(i)) for i in range(200)] + [(2, "same" * 25)] * 300
    out = assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit_bytes=1000, first_bits=3).collect()
    assert len(out) == 500 and sorted((r.doc_id, r.text) for r in out) == sorted(rows)
    size = defaultdict(int)
    for r in out:
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 1000 and all(size[r.shard] == r.shard_bytes for r in out)
    pages = {r.shard for r in out if r.doc_id == 2}
    assert len(pages) == 30 and all("+" in p for p in pages)


def test_awkward_rows(awkward):
    from pyspark.sql import functions as F
    df = awkward.withColumn("shard", F.lit("mine"))
    out = assign_shards(df, limit_bytes=60, first_bits=2)
    assert out.columns == ["doc_id", "text", "n_lines", "key", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows"]
    rows = out.collect()
    assert sorted(r.key for r in rows) == list(range(11))
    assert all(r.shard_bytes <= 60 or r.shard_rows == 1 for r in rows)
    assert {r.n_bytes for r in rows if r.text is None} == {0}
    assert assign_shards(df.limit(0)).count() == 0


def test_all_in_one_shard(spark):
    out = assign_shards(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), limit_bytes=2).collect()
    assert {(r.shard, r.depth, r.shard_bytes, r.shard_rows) for r in out} == {("", 0, 2, 2)}
