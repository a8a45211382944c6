"""Hard-negative mining by BOND: a vertical scan with branch-and-bound on partial scores.

Components are quantised to integers and stored as columns, one binary per dimension, in
blocks of rows. An anchor reads a block's columns in descending order of its own
components' size, so the dimensions that decide most come first. After every few columns
the least and the most that the columns still unread can add (from each column's minimum
and maximum in the block) bound every candidate's score, and the bitmap of candidates
shrinks: for positives to rows that may still be among the first ``k`` of the anchor's
label; for negatives to rows of other labels whose score may still fall in a window
[low * positive, positive] and beat what the task has already found there. What is left
when all columns are read is exact.

Rows are never shuffled by anchor: anchors go out in slices of ``anchor_slice`` rows (a
fixed number, about 8 MB at 64 dimensions), each slice makes one pass over the blocks for
its positives and one for its negatives, every task returns its own first few per anchor,
and Spark merges those. No bucket, label or copied vector is a key of the scan, so none
can be hot; memory is one block, one slice and its first few.

Defined results: rows with a null id or label, or a vector that is null or holds a null or
non-finite component take no part, nor do rows with a quantised component of 2**28 or more
in size (their products may not fit a long); of rows that share an id the first by label
and vector counts; a vector shorter than the longest counts as filled up with zeros, so an
empty one scores 0; ties go to the smaller id; a negative positive score has an empty
window; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import landed, map_arrow
from .vectors import dimensions, matrix, slices, vector_rows

BLOCK_ROWS, STEP, LARGEST = 8192, 8, 1 << 28
BLOCK = "ids binary, labels binary, cols array<binary>"


class Block:
    """Columns of a block of rows, their extremes, and its rows by label."""

    def __init__(self, ids: bytes, labels: bytes, cols: list[bytes]):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.cols = [np.frombuffer(c, np.int32) for c in cols]
        self.low = np.array([c.min() for c in self.cols], np.int64)
        self.high = np.array([c.max() for c in self.cols], np.int64)
        order = np.argsort(self.labels, kind="stable")
        values, at = np.unique(self.labels[order], return_index=True)
        self.of_label = dict(zip(values.tolist(), np.split(order, at[1:])))

    def scan(self, anchor: np.ndarray, rows: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``prune`` leaves, and their exact scores. ``prune(least, most)`` is
        called with bounds of the scores and returns which candidates stay."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order]
        ends = a * self.low[order], a * self.high[order]
        rest = [np.append(np.cumsum(f(*ends)[::-1])[::-1], 0) for f in (np.minimum, np.maximum)]
        score = np.zeros(len(rows), np.int64)
        for start in range(0, len(order), STEP):
            for j in range(start, min(start + STEP, len(order))):
                if a[j]:
                    score += self.cols[order[j]][rows] * a[j]
            left = min(start + STEP, len(order))
            stay = prune(score + rest[0][left], score + rest[1][left])
            if not stay.all():
                rows, score = rows[stay], score[stay]
            if not len(rows):
                break
        return rows, score


def column_blocks(rows: DataFrame, dims: int, scale: int) -> DataFrame:
    """``rows`` (id, label, vec) as blocks of columns of floor(scale * component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, BLOCK_ROWS):
                q = np.floor(matrix(part.column(2), dims) * scale)
                fits = (np.abs(q) < LARGEST).all(1)
                q = q[fits].astype(np.int32)
                if not len(q):
                    continue
                ids, labels = (np.asarray(part.column(i), np.int64)[fits] for i in (0, 1))
                cols = pa.array([[np.ascontiguousarray(c).tobytes() for c in q.T]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([labels.tobytes()]), cols], ["ids", "labels", "cols"])

    return map_arrow(rows.select("id", "label", "vec"), run, BLOCK)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*(batch.column(c)[i].as_py() for c in range(3)))


def _first(found: list, ids, scores, k: int) -> list:
    """The first ``k`` by score, then id, of ``found`` and the new (score, id) pairs."""
    return sorted([*found, *zip(scores.tolist(), ids.tolist())], key=lambda x: (-x[0], x[1]))[:k]


def nearest_of_label(blocks: DataFrame, anchors: list, k: int) -> DataFrame:
    """Each task's first ``k`` other rows of every anchor's label: ``anchor``, ``id``,
    ``score``. ``anchors``: (id, label, components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in anchors]
        for block in blocks_of(batches):
            for n, (own, label, vec) in enumerate(anchors):
                rows = block.of_label.get(label)
                if rows is None:
                    continue
                rows = rows[block.ids[rows] != own]
                floor = best[n][-1][0] if len(best[n]) == k else None

                def prune(least, most):
                    at = np.partition(least, len(least) - k)[len(least) - k] if len(least) >= k else None
                    bound = max((x for x in (at, floor) if x is not None), default=None)
                    return np.ones(len(most), bool) if bound is None else most >= bound

                rows, score = block.scan(vec, rows, prune)
                best[n] = _first(best[n], block.ids[rows], score, k)
        out = [(anchors[n][0], i, s) for n, found in enumerate(best) for s, i in found]
        yield _batch(out, ["anchor", "id", "score"])

    return map_arrow(blocks, run, "anchor long, id long, score long")


def within_windows(blocks: DataFrame, anchors: list, windows: list, k: int) -> DataFrame:
    """Each task's first ``k`` rows of other labels in every window of every anchor:
    ``anchor``, ``positive``, ``id``, ``score``. ``windows``: per anchor a list of
    (positive, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[[] for _ in w] for w in windows]
        for block in blocks_of(batches):
            for n, (_, label, vec) in enumerate(anchors):
                if not windows[n]:
                    continue
                # a window that already has k rows takes only what is at least its last score
                spans = [(max(low, found[-1][0]) if len(found) == k else low, high) for (_, low, high), found in zip(windows[n], best[n])]

                def prune(least, most):
                    return reduce(np.logical_or, [(most >= low) & (least <= high) for low, high in spans])

                rows, score = block.scan(vec, np.flatnonzero(block.labels != label), prune)
                for w, (low, high) in enumerate(spans):
                    inside = np.flatnonzero((score >= low) & (score <= high))
                    if len(inside) > 4 * k:  # all that reach the k-th score, ties among them
                        inside = inside[score[inside] >= np.partition(score[inside], -k)[-k]]
                    best[n][w] = _first(best[n][w], block.ids[rows[inside]], score[inside], k)
        out = [(anchors[n][0], windows[n][w][0], i, s) for n, per in enumerate(best) for w, found in enumerate(per) for s, i in found]
        yield _batch(out, ["anchor", "positive", "id", "score"])

    return map_arrow(blocks, run, "anchor long, positive long, id long, score long")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding",
                   label: Column | None = None, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100),
                   scale: int = 256, anchor_slice: int = 16384) -> DataFrame:
    """Per anchor (rows where ``is_anchor`` of the column ``id`` holds) and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other labels whose
    score is between ``low[0] / low[1]`` of the positive's score and that score:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``."""
    label = F.col("label") if label is None else label
    rows = landed(vector_rows(df, id_col, vec_col, label=label.cast("long")), "mining-rows")
    dims = dimensions(rows)
    blocks = landed(column_blocks(rows, dims, scale), "mining-blocks")
    chosen = rows.where(is_anchor)
    n_slices = -(-max(1, chosen.count()) // anchor_slice)
    parts = []
    for n in range(n_slices):
        part = chosen.where(F.pmod(F.xxhash64("id"), F.lit(n_slices)) == n).select("id", "label", "vec").toArrow()
        vecs = np.floor(matrix(part.column(2).combine_chunks(), dims) * scale) if part.num_rows else np.zeros((0, dims))
        fits = (np.abs(vecs) < LARGEST).all(1)
        anchors = [(i, la, v.astype(np.int64)) for i, la, v, ok in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), vecs, fits) if ok]
        near = landed(_ranked(nearest_of_label(blocks, anchors, positives), positives, "anchor"), "mining-positives")
        spans: dict[int, list] = {}
        for r in near.collect():  # at most anchor_slice * positives rows
            if r.score >= 0:
                spans.setdefault(r.anchor, []).append((r.id, -(-low[0] * r.score // low[1]), r.score))
        found = _ranked(within_windows(blocks, anchors, [spans.get(a[0], []) for a in anchors], negatives), negatives, "anchor", "positive")
        scores = near.select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score"))
        parts.append(landed(found.join(scores, ["anchor", "positive"]), "mining-negatives"))
    return reduce(DataFrame.unionByName, parts).select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
