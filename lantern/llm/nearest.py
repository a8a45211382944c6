"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table's hash turns a unit vector by three rounds of random signs and a fast Hadamard
transform, and names the signed axis that the turned vector is nearest to. Every vector is
in every table, in its one bucket. A query looks into buckets in two rounds:

1. a pilot looks into the nearest few axes of two tables and ranks what it meets exactly,
   which bounds the distance of the query's ``k``-th neighbour from above;
2. for a neighbour at that distance, the chance of each bucket of each table is estimated
   by sampling directions around the query (fixed seed); buckets are taken from the nearest
   axis outwards, over all tables, until the chance that such a neighbour has been met in at
   least one table reaches ``target``. Closer neighbours are likelier still, so ``target`` is
   a floor of the expected recall at every table size; clustered vectors need a bucket or
   two a table, vectors without any structure a good part of them. A query whose pilot met
   fewer than ``k`` others plans for the opposite point, which takes in nearly every bucket.

Candidates are reranked by the exact Euclidean distance of the original vectors, summed in
order of dimension in double precision.

Equal vectors are one class with its ``k + 1`` smallest ids, since no list can hold more of
them; copies therefore cost nothing, as queries or as rows. A bucket is worked off in cells
of at most ``CELL_ROWS`` rows and ``CELL_QUERIES`` queries, each returning its own first few,
so a hot bucket spreads over as many tasks as it needs and nothing is left out. Memory is
the queries of one cell and one batch of rows.

Defined results: rows with a null id, or a vector that is null, empty, zero or holds a null
or non-finite component take no part; of rows that share an id the first by vector counts;
a vector shorter than the longest counts as filled up with zeros; ties go to the smaller
id; fewer than ``k`` others give as many as there are; an empty table gives no rows; extra
columns are not read. Vectors of different lengths are hashed by direction only, so recall
is planned for vectors of about equal length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import landed, map_arrow
from .vectors import dimensions, matrix, slices, vector_rows

TABLES, PILOT_TABLES, PILOT_PROBES, TARGET = 8, 2, 4, 0.95
CELL_ROWS, CELL_QUERIES, SAMPLES, SEED = 8192, 1024, 1024, 20_231


class Turns:
    """The pseudo-rotations of all tables, for vectors of ``dims`` components."""

    def __init__(self, dims: int, tables: int = TABLES):
        self.size = 1 << max(0, dims - 1).bit_length()
        rng = np.random.default_rng([SEED, dims])
        self.signs = rng.choice([-1.0, 1.0], (tables, 3, self.size))
        self.noise = rng.standard_normal((SAMPLES, self.size))

    def __call__(self, unit: np.ndarray, table: int) -> np.ndarray:
        """Rows of unit vectors, turned; filled up to a power of two with zeros."""
        n = len(unit)
        x = np.zeros((n, self.size))
        x[:, :unit.shape[1]] = unit
        for signs in self.signs[table]:
            x, half = x * signs, 1
            while half < self.size:
                y = x.reshape(n, -1, 2, half)
                x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(n, self.size)
                half *= 2
            x /= self.size ** 0.5
        return x


def axes(turned: np.ndarray) -> np.ndarray:
    """The nearest signed axis of each row: 2 * axis, plus 1 on its negative side."""
    at = np.abs(turned).argmax(1)
    return 2 * at + (turned[np.arange(len(turned)), at] < 0)


def chances(turned: np.ndarray, noise: np.ndarray, cosine: float) -> np.ndarray:
    """How often each signed axis is nearest among vectors at ``cosine`` to the turned one."""
    off = noise - np.outer(noise @ turned, turned)
    off /= np.linalg.norm(off, axis=1, keepdims=True) + 1e-300
    met = axes(cosine * turned + max(0.0, 1 - cosine * cosine) ** 0.5 * off)
    return np.bincount(met, minlength=2 * len(turned)) / len(noise)


def signed(turned: np.ndarray) -> np.ndarray:
    """The closeness of each signed axis, in the order of their numbers."""
    return np.stack((turned, -turned), 1).ravel()


def unit_rows(vecs: np.ndarray) -> np.ndarray:
    vecs = vecs / np.abs(vecs).max(1, keepdims=True)
    return vecs / np.linalg.norm(vecs, axis=1, keepdims=True)


def vector_classes(df: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (``class``: its smallest id, ``vec``, ``ids``: the ``k + 1``
    smallest), and all rows (``id``, ``vec``)."""
    rows = vector_rows(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    rows = landed(rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))), "nearest-rows")  # -0.0 is 0.0
    w = Window.partitionBy("vec").orderBy("id")
    first = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1)
    classes = first.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return landed(classes.select(F.col("ids")[0].alias("class"), "vec", "ids"), "nearest-classes"), rows


def buckets(classes: DataFrame, dims: int, kind: str = "<f8") -> DataFrame:
    """The index: a row per class and table, with the bucket and the vector's bytes (``kind``:
    four to a component where the vectors came as floats, which loses nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Turns(dims)
        for batch in batches:
            for part in slices(batch, 1024):
                vecs = matrix(part.column(1), dims)
                unit, data = unit_rows(vecs), pa.array([v.tobytes() for v in vecs.astype(kind)], pa.binary())
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(t, pa.int32()), len(vecs)), pa.array(axes(turns(unit, t)).astype(np.int32)), part.column(0), data],
                        ["table", "bucket", "class", "data"])

    return landed(map_arrow(classes.select("class", "vec"), run, "table int, bucket int, class long, data binary"), "nearest-index")


def probes(queries: DataFrame, dims: int, pilot: bool, target: float = TARGET, kind: str = "<f8") -> DataFrame:
    """Buckets to look into: ``table``, ``bucket``, ``query``, ``data``. ``queries``: ``class``,
    ``vec`` and ``far``, the square of the distance to plan for (null: as far as it gets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = Turns(dims)
        for batch in batches:
            for part in slices(batch, 256):
                vecs = matrix(part.column(1), dims)
                unit = unit_rows(vecs)
                turned = [turns(unit, t) for t in range(PILOT_TABLES if pilot else TABLES)]
                far = part.column(2).to_pylist()
                for n, own in enumerate(part.column(0).to_pylist()):
                    if pilot:
                        picked = [(t, b) for t, x in enumerate(turned) for b in np.argsort(-signed(x[n]), kind="stable")[:PILOT_PROBES].tolist()]
                    else:
                        length = float(vecs[n] @ vecs[n])
                        cosine = -1.0 if far[n] is None else min(max(1 - far[n] / (2 * length), -1.0), 1.0)
                        picked = _outwards([signed(x[n]) for x in turned], [chances(x[n], turns.noise, cosine) for x in turned], target)
                    t, b = (np.array(x, np.int32) for x in zip(*picked))
                    data = pa.repeat(pa.scalar(vecs[n].astype(kind).tobytes(), pa.binary()), len(t))
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(b), pa.repeat(own, len(t)), data], ["table", "bucket", "query", "data"])

    return map_arrow(queries.select("class", "vec", "far"), run, "table int, bucket int, query long, data binary")


def _outwards(near: list[np.ndarray], chance: list[np.ndarray], target: float) -> list[tuple[int, int]]:
    """Buckets of all tables, nearest axis first, until a neighbour has been met in some
    table with chance ``target``."""
    flat, width = np.concatenate(chance), len(chance[0])
    missed, out = [1.0] * len(chance), []
    for at in np.argsort(-np.concatenate(near), kind="stable").tolist():
        t, b = divmod(at, width)
        out.append((t, b))
        if flat[at]:
            missed[t] = max(0.0, missed[t] - flat[at])
            if 1 - np.prod(missed) >= target:
                break
    return out


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances, each summed in order of dimension."""
    out = np.zeros((len(queries), len(rows)))
    for q, r in zip(queries.T, rows.T):
        apart = q[:, None] - r[None, :]
        apart *= apart
        out += apart
    return out


def _cells(index: DataFrame, looks: DataFrame) -> DataFrame:
    """Rows and queries of each bucket that is looked into, dealt out to cells, queries
    before rows: ``table``, ``bucket``, ``row_cell``, ``query_cell``, ``is_row``, ``id``, ``data``."""
    place = ["table", "bucket"]
    sizes = looks.groupBy(*place).agg(F.count("*").alias("nq")).join(index.groupBy(*place).agg(F.count("*").alias("nr")), place)
    sizes = landed(sizes.select(*place, F.ceil(F.col("nr") / CELL_ROWS).cast("int").alias("rc"),
                                F.ceil(F.col("nq") / CELL_QUERIES).cast("int").alias("qc")), "nearest-cells")

    def dealt(df, key, own, other, own_n, other_n, is_row):
        cell = F.pmod(F.xxhash64(key), F.col(own_n)).cast("int").alias(own)
        copies = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other)
        return df.join(sizes, place).select(*place, cell, copies, F.lit(is_row).alias("is_row"), F.col(key).alias("id"), "data")

    rows = dealt(index, "class", "row_cell", "query_cell", "rc", "qc", True)
    asked = dealt(looks, "query", "query_cell", "row_cell", "qc", "rc", False)
    cell = [*place, "row_cell", "query_cell"]
    both = rows.unionByName(asked)
    return both.repartition(*cell).sortWithinPartitions(*cell, "is_row").select(*cell, "is_row", "id", "data")


def _nearest_of_cells(cells: DataFrame, dims: int, k: int, kind: str) -> DataFrame:
    """The first ``k`` classes of each query in each cell: ``query``, ``class``, ``apart``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asked, vecs, parts = None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([np.asarray(batch.column(i), np.int64) for i in range(4)], 1)
            is_row = batch.column(4).to_numpy(zero_copy_only=False)
            ids = np.asarray(batch.column(5), np.int64)
            data = np.frombuffer(b"".join(batch.column(6).to_pylist()), kind).reshape(-1, dims).astype(float)
            edge = np.flatnonzero((np.diff(key, axis=0) != 0).any(1) | (is_row[1:] != is_row[:-1])) + 1
            for a, b in zip([0, *edge], [*edge, len(ids)]):
                cell = tuple(key[a])
                if cell != here:
                    here, asked, vecs, parts = cell, None, None, []
                if not is_row[a]:  # a cell's queries may come in several batches
                    parts.append((ids[a:b], data[a:b]))
                elif parts:
                    if vecs is None or len(asked) < sum(len(p[0]) for p in parts):
                        asked, vecs = (np.concatenate(x) for x in zip(*parts))
                    for q in range(0, len(asked), 256):
                        yield from _first(asked[q:q + 256], vecs[q:q + 256], ids[a:b], data[a:b], k)

    return map_arrow(cells, run, "query long, class long, apart double")


def _first(asked, vecs, ids, rows, k) -> Iterator[pa.RecordBatch]:
    apart = distances(vecs, rows)
    if len(ids) > k:
        near = apart <= np.partition(apart, k - 1, axis=1)[:, k - 1:k]  # ties of the k-th stay
    else:
        near = np.ones(apart.shape, bool)
    q, r = np.nonzero(near)
    yield pa.RecordBatch.from_arrays([pa.array(asked[q]), pa.array(ids[r]), pa.array(apart[q, r])], ["query", "class", "apart"])


def _search(index: DataFrame, queries: DataFrame, dims: int, k: int, pilot: bool, target: float = TARGET, kind: str = "<f8") -> DataFrame:
    """The first ``k`` classes met by each query, its own among them."""
    looks = landed(probes(queries, dims, pilot, target, kind), "nearest-probes")
    if pilot:
        index = index.where(F.col("table") < PILOT_TABLES)
    met = _nearest_of_cells(_cells(index, looks), dims, k, kind).distinct()
    w = Window.partitionBy("query").orderBy("apart", "class")
    return met.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
            target: float = TARGET) -> DataFrame:
    """The ``k`` nearest found for each row where ``is_query`` of the column ``id`` holds:
    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the Euclidean distance."""
    classes, rows = vector_classes(df, id_col, vec_col, k)
    dims = dimensions(classes)
    kind = "<f4" if isinstance(df.schema[vec_col].dataType.elementType, FloatType) else "<f8"
    index = buckets(classes, dims, kind)
    asked = landed(rows.where(is_query).join(classes.select("vec", "class"), "vec").select("id", "class"), "nearest-queries")
    queries = classes.join(asked.select("class").distinct(), "class").select("class", "vec", F.size("ids").alias("copies"))
    first = _search(index, queries.withColumn("far", F.lit(None).cast("double")), dims, k + 1, True, target, kind)
    sized = first.join(classes.select("class", F.size("ids").alias("n")), "class")
    w = Window.partitionBy("query").orderBy("apart", "class")
    far = sized.withColumn("__sum", F.sum("n").over(w)).where(F.col("__sum") >= k + 1).groupBy("query").agg(F.min("apart").alias("far"))
    planned = landed(queries.join(far.withColumnRenamed("query", "class"), "class", "left"), "nearest-planned")
    found = _search(index, planned, dims, k + 1, False, target, kind)
    members = found.join(classes.select("class", "ids"), "class").select("query", "apart", F.explode("ids").alias("vec_id"))
    w = Window.partitionBy("query").orderBy("apart", "vec_id")
    members = members.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k + 1)
    lists = members.join(asked.withColumnRenamed("class", "query"), "query").where(F.col("vec_id") != F.col("id"))
    w = Window.partitionBy("id").orderBy("apart", "vec_id")
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        F.col("id").alias("query_id"), "rank", "vec_id", F.sqrt("apart").alias("score"))
