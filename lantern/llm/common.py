"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """A-Z lowered, every other character kept. Pure-ASCII text (as many bytes as
    characters) takes ``lower``, which is then the same and several times faster
    than ``translate``."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, UPPER, UPPER.lower()))


def digest128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes of the columns under different seeds: a fixed-width key
    that stays in generated code. Nulls are skipped by the hash, so a null flag per
    column goes in as well."""
    flags = [c.isNull() for c in cols]
    return [F.xxhash64(*cols, *flags), F.xxhash64(F.lit(7919), *flags, *cols)]


def map_arrow(df: DataFrame, run, schema, batch_bytes: int = 2 << 20) -> DataFrame:
    """``mapInArrow`` with batches of ``batch_bytes`` at most, or a row: with long texts the
    default of 10,000 rows is tens of megabytes in the JVM, in the worker and in its copies.
    The setting stays with the session, since the plan is made when the frame is used."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    return df.mapInArrow(run, schema)


_HELD: dict = {}


def held(key, make):
    """What a Python worker builds once and keeps between tasks: one thing at a time, so
    that a worker that serves several operators does not gather their models."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage is
    cut, and a lost executor costs no recomputation of what was written."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir.rstrip('/')}/{table}.parquet"
