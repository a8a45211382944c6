import hashlib

import pytest
from plain import AWKWARD, SF, ascii_lower
from pyspark.sql import functions as F

from lantern.llm.common import fresh_dir
from lantern.llm.exact_dedup import exact_dedup, update_state


def plain(rows):
    """(id, normalised text) -> keep id and group size."""
    groups = {}
    for i, t in rows:
        groups.setdefault(ascii_lower(t or ""), []).append(i)
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.fixture
def landed_awkward(spark, awkward, tmp_path):
    path = f"{tmp_path}/documents.parquet"
    awkward.repartition(3).write.parquet(path)
    return path


def test_whole_table(spark, documents):
    want = plain(documents.items())
    got = exact_dedup(spark, f"{SF}/documents.parquet").collect()
    assert len(got) == len(documents)
    for r in got:
        text = ascii_lower(documents[r.id])
        assert (r.keep_id, r.group_size) == want[text] and r.kept == (r.id == r.keep_id)
        assert r.digest == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("weak", [False, True])
def test_awkward_rows_with_and_without_colliding_digests(spark, landed_awkward, weak):
    params = {"digest": lambda t: (F.length(t) % 2).cast("string")} if weak else {}
    got = exact_dedup(spark, landed_awkward, **params).collect()
    want = plain(AWKWARD)
    assert sorted(str((r.keep_id, r.group_size)) for r in got) == sorted(str(want[ascii_lower(t or "")]) for _, t in AWKWARD)
    # one row of each text stays, though id 5 repeats
    assert sum(r.kept for r in got) == len(want)
    assert len({(r.file, r.row) for r in got}) == len(AWKWARD)


def test_restart_reads_only_new_files(spark, tmp_path):
    path, checkpoint = f"{tmp_path}/docs.parquet", fresh_dir(spark, "restart")
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").write.parquet(path)
    assert {(r.keep.id, r.n) for r in update_state(spark, path, checkpoint).collect()} == {(1, 1), (2, 1)}
    spark.createDataFrame([(3, "A"), (4, "c")], "doc_id long, text string").write.mode("append").parquet(path)
    assert {(r.keep.id, r.n) for r in update_state(spark, path, checkpoint).collect()} == {(3, 2), (2, 1), (4, 1)}
    assert sorted((r.id, r.keep_id, r.kept) for r in exact_dedup(spark, path, checkpoint).collect()) == [
        (1, 3, False), (2, 2, True), (3, 3, True), (4, 4, True)]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none.parquet")
    assert exact_dedup(spark, f"{tmp_path}/none.parquet").count() == 0


def test_rewritten_files_are_refused(spark, tmp_path):
    """A compaction under a kept checkpoint would count rows twice and keep rows that are gone."""
    import pytest
    df = spark.createDataFrame([(i, f"text {i % 20}") for i in range(40)], "doc_id long, text string")
    path, state = f"{tmp_path}/table", f"{tmp_path}/state"
    df.repartition(4).write.parquet(path)
    assert exact_dedup(spark, path, checkpoint=state).where("kept").count() == 20
    spark.createDataFrame([(99, "text 1")], df.schema).write.mode("append").parquet(path)  # added files are fine
    assert exact_dedup(spark, path, checkpoint=state).where("kept").count() == 20
    df.coalesce(1).write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="new checkpoint"):
        exact_dedup(spark, path, checkpoint=state)
    assert exact_dedup(spark, path).where("kept").count() == 20
