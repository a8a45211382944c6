"""Near-duplicates by MinHash bands, odd sketches and exact verification.

Rows with the same shingle set form a class, found by a 128-bit sum over the set, so
copies cost nothing further however many there are. Of each class:

1. MinHash samples give band keys; classes that share a key are candidates. Bands are
   as long as the miss rate at the threshold allows (``plan``: under 1e-6 a link).
2. The samples are folded into an odd sketch, a parity bitmap; the population count of
   two sketches' XOR estimates the similarity, and pairs under the threshold by more
   than five standard deviations go. A second parity bitmap, of the whole set, bounds
   the sets' difference from below, so what it rejects is certainly under the threshold.
3. What is left is confirmed on the full sets.

A bucket of any size is worked off without its pairs: first every member is held against
one leader, a different one in each band, which links nearly all that belongs together
at a cost linear in the bucket. Then only pairs of members from different components are
compared, sketch against sketch inside a task, in blocks of ``block`` members, and only
pairs that pass both bitmaps leave the task for exact verification. So no link between
components is left out, and a pair within a component adds nothing to the answer.

Defined results: null and empty texts have no shingles and link with nothing; rows that
repeat an id and a text are one document; where an id comes with several texts, each row
has the component of its own text, and a link of one text holds for the id; rows without
an id have no component (null) and are kept; an empty table gives no rows; extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import pieces
from .common import landed, map_arrow
from .components import components
from .shingles import (apart, band_keys, differing_bits, minhashes, odd_sketches, parities, shingle_sets)

BANDS, SPREAD = 32, 5.0
#: Text in a batch, and half of it in a piece: the JVM and the worker hold several copies.
BATCH_BYTES = 2 << 20


def plan(threshold: float) -> tuple[int, int, float]:
    """Samples per band, samples in all, and the most differing sketch bits let through."""
    rows = max(r for r in range(1, 13) if r == 1 or (1 - threshold ** r) ** BANDS <= 1e-6)
    samples = rows * BANDS
    # spread of the estimate: of the samples that agree, and of flips that fall on one bit
    away = samples * (1 - threshold)
    sigma = (samples * threshold * (1 - threshold) + 2 * away * away / 512) ** 0.5 / samples
    return rows, samples, differing_bits(max(0.0, threshold - SPREAD * sigma), samples)


def most_apart(a: int, b: int, threshold: Fraction) -> int:
    """The most elements that sets of sizes a and b can have apart at the threshold:
    shared >= t * union makes apart = a + b - 2 * shared <= (a + b) * (1 - t) / (1 + t)."""
    return int((a + b) * (1 - threshold) / (1 + threshold))


def signatures(df: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> DataFrame:
    """Per row: ``id``, ``n`` (set size), ``s1`` and ``s2`` (128-bit sum of the set),
    ``bands``, ``sketch`` and ``parity``; all but the first two null for empty sets."""
    rows, samples, _ = plan(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .shingles import mix

        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES // 2):
                flat, at = shingle_sets(piece.column(1), size)
                n = np.diff(at)
                full = np.flatnonzero(n)
                empty = n == 0
                at = np.append(at[full], len(flat))
                cols = [piece.column(0), pa.array(n)]
                if len(full):
                    mins = minhashes(flat, at, samples)
                    sums = [np.add.reduceat(x, at[:-1]).view(np.int64) for x in (flat, mix(flat))]
                    data = [*(pa.array(x) for x in sums), pa.array(list(band_keys(mins, rows).view(np.int64)), pa.list_(pa.int64())),
                            pa.array([x.tobytes() for x in odd_sketches(mins)], pa.binary()), pa.array(parities(flat, at), pa.binary())]
                    where = pa.array(np.cumsum(~empty) - 1, mask=empty)
                    cols += [x.take(where) for x in data]
                else:
                    cols += [pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "s1", "s2", "bands", "sketch", "parity"])

    rows_in = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(
        rows_in, run, "id long, n long, s1 long, s2 long, bands array<long>, sketch binary, parity binary", BATCH_BYTES)


def _passes(pairs: DataFrame, sketches: DataFrame, threshold: Fraction) -> DataFrame:
    """The pairs (``a``, ``b``) that neither the sizes nor the bitmaps rule out."""
    most = plan(float(threshold))[2]
    both = pairs
    for c in ("a", "b"):
        both = both.join(sketches.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch", "parity")]), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            x, y = (np.frombuffer(b"".join(col[f"sketch_{c}"].to_pylist()), np.uint64).reshape(-1, 8) for c in "ab")
            near = np.bitwise_count(x ^ y).sum(1) <= most
            ok = [k and apart(p, q) <= most_apart(n, m, threshold) for k, p, q, n, m in zip(
                near.tolist(), *(col[c].to_pylist() for c in ("parity_a", "parity_b", "n_a", "n_b")))]
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sized = both.where((F.least("n_a", "n_b") * threshold.denominator >= F.greatest("n_a", "n_b") * threshold.numerator))
    return map_arrow(sized, run, "a long, b long", BATCH_BYTES).distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, threshold: Fraction) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    # texts are dealt out by id at any size: a plan that broadcasts the nodes while they are
    # few would say nothing about the shuffle that a larger table needs
    texts = docs.join(nodes.hint("merge"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES // 2):
                flat, at = shingle_sets(piece.column(1), size)
                sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column(0), sets], ["node", "items"])

    sets = landed(map_arrow(texts.select("node", "text"), run, "node long, items array<long>", BATCH_BYTES), "shingle-sets")
    both = pairs
    for c in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(c), F.col("items").alias(f"items_{c}")), c)
    shared = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    union = F.size("items_a") + F.size("items_b") - shared
    return both.where(shared * threshold.denominator >= union * threshold.numerator).select("a", "b").distinct()


def _across(members: DataFrame, sketches: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """Pairs of members (``key``, ``node``, ``label``, ``size``) of one bucket with
    different labels that pass the sizes and both bitmaps."""
    most = plan(float(threshold))[2]
    num, den = threshold.numerator, threshold.denominator
    blocks = F.ceil(F.col("size") / block)
    mine = members.withColumn("blocks", blocks).withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = mine.select("key", "node", "label", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("y"))
    dealt = dealt.select("key", "node", "label", "x", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    dealt = dealt.join(sketches.select("node", "n", "sketch", "parity"), "node")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("n")
        node, label, n = (group[c].to_numpy() for c in ("node", "label", "n"))
        side, two = group["x"].to_numpy(), group["lo"][0].as_py() != group["hi"][0].as_py()
        sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(-1, 8)
        parity, out = group["parity"].to_pylist(), ([], [])
        reach = np.searchsorted(n, n * den // num, side="right")  # sizes that can still reach the threshold
        for i in range(len(node)):
            j = slice(i + 1, reach[i])
            ok = label[j] != label[i]
            if two:
                ok &= side[j] != side[i]
            at = np.flatnonzero(ok) + i + 1
            at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(1) <= most]
            for k in at.tolist():
                if apart(parity[i], parity[k]) <= most_apart(int(n[i]), int(n[k]), threshold):
                    out[0].append(min(node[i], node[k]))
                    out[1].append(max(node[i], node[k]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    threshold: Fraction = Fraction(4, 5), block: int = 2048) -> DataFrame:
    """Per row: ``id``, ``n_shingles``, ``component_id`` and ``kept``."""
    rows = landed(signatures(df, id_col, text_col, size, float(threshold)), "signatures")
    named = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    classes = landed(named.groupBy("n", "s1", "s2").agg(F.min("id").alias("node")), "classes")
    # one row of signatures for each class
    reps = named.join(classes.select("n", "s1", "s2", F.col("node").alias("id")), ["id", "n", "s1", "s2"])
    reps = landed(reps.dropDuplicates(["id", "n", "s1", "s2"]).select(F.col("id").alias("node"), "n", "bands", "sketch", "parity"), "class-signatures")
    sketches = reps.select("node", "n", "sketch", "parity")

    keys = reps.select("node", F.explode("bands").alias("key"))
    # the leader: the smallest node after a scramble that differs from bucket to bucket
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("m"))
    buckets = landed(buckets.where("size > 1").select("key", "size", F.col("m").bitwiseXOR(F.col("key")).alias("leader")), "buckets")
    members = landed(keys.join(buckets, "key"), "members")

    pair = members.where("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    first = landed(_passes(landed(pair.distinct(), "leader-pairs"), sketches, threshold), "leader-candidates")
    links = landed(_confirmed(first, docs, size, threshold), "leader-links")

    labels = components(links)
    labelled = members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = landed(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                       .where("lo <> hi").select("key"), "open-buckets")
    second = landed(_across(labelled.join(open_keys, "key"), sketches, threshold, block), "cross-candidates")
    second = landed(second.join(first, ["a", "b"], "left_anti"), "cross-untried")
    if not second.isEmpty():
        more = landed(_confirmed(second, docs, size, threshold), "cross-links")
        if not more.isEmpty():
            labels = components(links.union(more))

    found = rows.join(classes, ["n", "s1", "s2"], "left").join(labels, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("label", "node"))
    component = F.when(F.col("id").isNotNull(), component)
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """``df`` with one document, the smallest id, of each component. Rows that repeat an
    id stay or go together; rows without an id stay."""
    kept = near_duplicates(df, id_col, **params).where("kept AND id IS NOT NULL").select(F.col("id").alias("__kept")).distinct()
    stays = df.where(F.col(id_col).isNotNull()).join(kept, F.col(id_col).cast("long") == F.col("__kept"), "left_semi")
    return stays.unionByName(df.where(F.col(id_col).isNull()))
