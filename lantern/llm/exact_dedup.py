"""Exact dedup over a growing Parquet table as a stateful stream (DataFrame functions only).

A file stream runs a keyed aggregation whose state lives on disk (RocksDB, checkpointed
to the shared folder) and never expires. For each digest the state keeps the stable
identifier and the content locator (file and row) of the row that stays, and the number
of rows seen; partial aggregation in each task makes a group of any size one row per
task. A restart on the same checkpoint reads only files that are new. The state is then
read as a table and every hit, a row whose digest another row shares, is compared byte
for byte with the row that stays; rows that only share a digest are regrouped by their
whole text.

Defined results: null text counts as empty; texts are equal when identical after
lower-casing A-Z; of equal texts the largest id stays (a null id is the smallest), and
of rows that repeat that id the one latest by locator; ``keep_id`` is that row's id;
an empty table gives no rows; extra columns are not read. State knows rows by file and
place: with a checkpoint that is kept, files may be added but not rewritten or removed (a
compaction needs a new checkpoint); where a file that the state names is gone, a
``ValueError`` says so before anything is dropped. The path is a folder or file; brackets,
braces and stars in it are read as a pattern, as Spark's readers do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_dir, landed

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _located(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return df.select(
        digest(norm).alias("digest"), norm.alias("norm"),
        F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.row_index").alias("row")).alias("who"))


def update_state(spark: SparkSession, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text",
                 digest: Callable[[Column], Column] = sha256, bytes_per_batch: str | None = None) -> DataFrame:
    """Feed the files of ``path`` that the checkpoint has not seen to the state and return
    the state: ``digest``, ``keep`` (id, file, row) and ``n``."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    # as a pattern, the path may be a folder or a single file
    stream = _located(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col, digest).drop("norm")
    keyed = stream.groupBy("digest").agg(F.max("who").alias("keep"), F.count("*").alias("n"))
    conf = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
            "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
            # a store's local files go when its task has committed to the shared folder
            "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        query = (keyed.writeStream.format("noop").outputMode("update")
                 .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keep"),
                        F.col("value.count").alias("n"))


def exact_dedup(spark: SparkSession, path: str, checkpoint: str | None = None, id_col: str = "doc_id",
                text_col: str = "text", digest: Callable[[Column], Column] = sha256,
                bytes_per_batch: str | None = None) -> DataFrame:
    """One row per row of the table at ``path``: ``id``, ``keep_id``, ``group_size``,
    ``kept``, ``digest``, and the locator ``file`` and ``row``."""
    kept_state = checkpoint is not None
    checkpoint = checkpoint or fresh_dir(spark, "exact-state")
    if spark.read.parquet(path).isEmpty():  # a stream over no file commits no batch, so there is no state
        state = spark.createDataFrame([], "digest string, keep struct<id:bigint,file:string,row:bigint>, n bigint")
    else:
        state = update_state(spark, path, checkpoint, id_col, text_col, digest, bytes_per_batch)
    state = landed(state, "exact-digests")
    docs = _located(spark.read.parquet(path), id_col, text_col, digest)
    if kept_state:
        here = docs.select(F.col("who.file").alias("file")).distinct()
        if not state.select(F.col("keep.file").alias("file")).distinct().join(here, "file", "left_anti").isEmpty():
            raise ValueError(f"files that the state in {checkpoint} was built from are gone from {path}: start a new checkpoint")
    seen = landed(docs.select("digest", "who").join(state, "digest"), "exact-seen")
    # the texts of digests that two rows or more share; where those digests are too many to
    # broadcast, the join deals out every text by its digest first
    hits = landed(docs.join(state.where("n > 1").select("digest", "keep"), "digest"), "exact-hits")
    keeper = hits.where(F.col("who").eqNullSafe(F.col("keep"))).select("digest", F.col("norm").alias("keep_norm"))
    strays = landed(hits.join(keeper, "digest").where("norm <> keep_norm").select("digest", "who", "norm"), "exact-strays")
    if not strays.isEmpty():
        seen = _regroup(seen, strays)
    return seen.select(
        F.col("who.id").alias("id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("who").eqNullSafe(F.col("keep")).alias("kept"), "digest",
        F.col("who.file").alias("file"), F.col("who.row").alias("row"))


def _regroup(seen: DataFrame, strays: DataFrame) -> DataFrame:
    """Rows that share a digest but not the bytes of the row that stays: by whole text."""
    gone = strays.groupBy("digest").agg(F.count("*").alias("gone"))
    groups = landed(strays.groupBy("digest", "norm").agg(F.max("who").alias("keep"), F.count("*").alias("n")), "exact-regrouped")
    moved = landed(strays.join(groups, ["digest", "norm"]).select("digest", "who", "keep", "n"), "exact-moved")
    good = seen.join(moved.select("digest", "who"), ["digest", "who"], "left_anti").join(gone, "digest", "left")
    good = good.select("digest", "who", "keep", (F.col("n") - F.coalesce(F.col("gone"), F.lit(0))).alias("n"))
    return good.unionByName(moved)
