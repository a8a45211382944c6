"""Sharding by extendible hashing (DataFrame functions only).

A directory is indexed by the leading bits of a row's hash. It starts as one bucket;
only a bucket over the byte limit is split on its next bit, until every shard fits.
Sizes are counted once at a first depth (partial sums before the shuffle) and, only
for prefixes that are still too large there, again at a greater depth, so a table is
read twice or three times, not once per bit. Only the directory is shuffled to the
rows, by an equi-join on the prefix.

The hash has 60 bits of the key followed by 60 bits of the whole row, so a key that
holds a third of all rows is split too. Rows that are the same in every column have
the same 120 bits; such a bucket is cut into pages of ``limit_bytes``.

Defined results: a row weighs the bytes of its text (null: 0); a shard of a single row
may exceed the limit, any other shard does not; a null key hashes as the empty string;
an empty table gives no rows; other columns pass through, and input columns named like
the outputs (``shard``, ``depth``, ``n_bytes``, ``shard_bytes``, ``shard_rows``) are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import landed

KEY_BITS, MAX_BITS = 60, 120
OUT = ("shard", "depth", "n_bytes", "shard_bytes", "shard_rows")


def hash_bits(col: Column) -> Column:
    """The first 60 bits of the md5 of a string column, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(col), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def _row_string(df: DataFrame, cols: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def directory(sizes: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Entries at ``high`` bits with the shallowest prefix of ``low`` to ``high`` bits
    that fits: ``prefix``, ``shard`` (null: none fits), ``shard_bytes``, ``shard_rows``."""
    at = sizes.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    at = at.withColumn("shard", F.expr("substring(prefix, 1, depth)"))
    total = at.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    fits = at.select("prefix", "depth", "shard").join(total, ["depth", "shard"]).where(
        (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    best = fits.groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("b"))
    return sizes.select("prefix", "bytes").join(
        best.select("prefix", "b.shard", "b.shard_bytes", "b.shard_rows"), "prefix", "left")


def assign_shards(df: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                  limit_bytes: int = 1 << 20, first_bits: int = 12) -> DataFrame:
    """``df`` with ``shard`` (the bit prefix; pages of identical rows end in ``+page``),
    ``depth``, ``n_bytes``, ``shard_bytes`` and ``shard_rows``."""
    cols = [c for c in df.columns if c not in OUT]
    key_bits = hash_bits(F.coalesce(F.col(key_col).cast("string"), F.lit("")))
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")

    def bits(to: int) -> Column:  # the whole row is hashed only where its bits are asked for
        b = key_bits if to <= KEY_BITS else F.concat(key_bits, hash_bits(_row_string(df, cols)))
        return F.substring(b, 1, to)

    tables, low, high, rest = [], 0, first_bits, df.select(*cols)
    while True:
        sizes = landed(rest.groupBy(bits(high).alias("prefix")).agg(
            F.sum(n_bytes).alias("bytes"), F.count("*").alias("rows")), "shard-sizes")
        table = landed(directory(sizes, low, high, limit_bytes), "shard-directory")
        tables.append((high, table))
        over = table.where(F.col("shard").isNull())
        largest = over.agg(F.max("bytes")).head()[0]  # one number
        if largest is None or high == MAX_BITS:
            break
        rest = rest.withColumn("__prefix", bits(high)).join(
            over.select(F.col("prefix").alias("__prefix")), "__prefix", "left_semi").select(*cols)
        step = min(first_bits, 1 + math.ceil(math.log2(max(2.0, largest / limit_bytes))))
        low, high = high + 1, min(MAX_BITS, high + step)
        if low <= KEY_BITS < high:
            high = KEY_BITS

    out = df.select(*cols)
    for i, (depth, table) in enumerate(tables):
        out = out.withColumn("__prefix", bits(depth)).join(table.select(
            F.col("prefix").alias("__prefix"), F.struct("shard", "shard_bytes", "shard_rows").alias(f"__d{i}")), "__prefix", "left")
    found = [F.when(F.col(f"__d{i}.shard").isNotNull(), F.col(f"__d{i}")) for i in range(len(tables))]
    out = out.withColumn("__d", F.coalesce(*found))
    done = out.where(F.col("__d").isNotNull()).select(
        *cols, F.col("__d.shard").alias("shard"), F.length("__d.shard").alias("depth"), n_bytes.alias("n_bytes"),
        F.col("__d.shard_bytes").alias("shard_bytes"), F.col("__d.shard_rows").alias("shard_rows"))
    if largest is None:
        return done
    # Identical rows only: one row with its count, dealt out again over pages.
    same = out.where(F.col("__d").isNull()).groupBy(*cols).agg(F.count("*").alias("__n"))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit_bytes) / F.greatest(n_bytes, F.lit(1)))).cast("long")
    same = same.withColumn("__per", per).select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i"))
    page = F.floor(F.col("__i") / F.col("__per"))
    rows = F.least(F.col("__per"), F.col("__n") - page * F.col("__per"))
    return done.unionByName(same.select(
        *cols, F.concat(bits(MAX_BITS), F.lit("+"), page.cast("string")).alias("shard"), F.lit(MAX_BITS).alias("depth"),
        n_bytes.alias("n_bytes"), (n_bytes * rows).alias("shard_bytes"), rows.alias("shard_rows")))


def write_shards(df: DataFrame, path: str, **params) -> None:
    """Write the rows below ``path`` as Parquet, one folder per shard."""
    out = assign_shards(df, **params)
    out.repartition("shard").write.partitionBy("shard").mode("errorifexists").parquet(path)
