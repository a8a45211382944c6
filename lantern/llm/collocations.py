"""Phrase collocations by SETM: set-oriented mining over persisted occurrence relations.

Level k keeps two relations. ``L_k`` has a row per frequent k-word phrase (of one
language): a dense number ``id``, the phrase, its count and the counts of all its prefixes
and suffixes. ``R_k`` has the occurrences of those phrases, sorted by position: each row
holds a stretch of text as two parallel arrays, positions and phrase numbers, in which a
piece's words have consecutive positions and a gap stands between pieces. Then, level by
level:

1. merge-join: ``R_k`` with itself where the second position is the first plus one (both
   sides are the same sorted array, so the merge is one pass over neighbours);
2. group-count: pairs of phrase numbers are counted within the task, then by Spark;
3. semi-join: pairs found ``min_count`` times or more become ``L_k+1``, and ``R_k`` joined
   against them becomes ``R_k+1``, written again. Nothing infrequent is extended.

Every word of a frequent phrase, and both parts of every cut, are frequent themselves, so
the counts that scores need are all in ``L``.

The semi-join hands ``L`` to the tasks in slices of ``SLICE`` rows, a fixed number that
bounds driver and worker; each slice is one pass over the occurrences, in which its hits
join those of the slices before. Stretches of more than ``STRETCH`` positions are cut with an
overlap of ``OVERLAP`` words, so one endless text is no large row, and rows stay under the
size that the JVM's collector treats as huge. A word, pair, language or
text that holds a third of everything is counted down inside its tasks before any shuffle.

Defined results: null text counts as empty and gives nothing; a null language is ``und``;
every row is a text, rows that repeat count as often as they occur; ties in a cut's score
go to the shorter first part, ties in rank to the higher count, then the phrase in byte
order; a language without candidates has no rows; an empty table gives no rows; other
columns are not read. A level may hold 2**31 phrases, beyond that an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import pieces
from .common import UPPER, landed, map_arrow

SLICE, STRETCH, OVERLAP, PIECE_BYTES, HELD = 1 << 21, 1 << 15, 3, 2 << 20, 2 << 20
#: A-Z to a-z; the characters that end a piece to a line feed; a tab to a space.
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", UPPER.lower().encode() + b"\n" * 10 + b" ")
OCCURRENCES = "own long, pos binary, id binary"


def words_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words of the text in order, and their positions: one apart within a piece, further
    apart across the end of a piece."""
    flat = np.frombuffer(text.translate(_TABLE), np.uint8)
    end = flat == 10
    word = ~end & (flat != 32)
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate(([0], np.cumsum(stop - start)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat[word])])
    return words, np.arange(len(start), dtype=np.int32) + np.cumsum(end, dtype=np.int32)[start]


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """The batch's texts by language, some megabytes at a time, a line feed between texts."""
    for piece in pieces(batch, "text", PIECE_BYTES):
        langs = piece.column(0)
        for lang in pc.unique(langs).to_pylist():
            yield lang, b"\n".join(piece.column(1).filter(pc.equal(langs, lang)).to_pylist())


def word_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of each word: ``lang``, ``word``, ``n``; counted by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in _by_lang(batch):
                found = words_of(text)[0].value_counts()
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(found)), found.field(0).cast(pa.binary()), found.field(1)], ["lang", "word", "n"])

    return map_arrow(texts, run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, with dense numbers ``id`` from 0: each written part's rows are counted,
    and a row's number is its place in the part plus the rows of the parts before."""
    rows = landed(df.withColumn("__at", F.monotonically_increasing_id()), f"{name}-rows")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted(rows.groupBy(part.alias("part")).count().collect())  # a row per written part
    first, total = {}, 0
    for p, n in counts:
        first[p] = total
        total += n
    if total >= 1 << 31:
        raise ValueError(f"{total} frequent phrases of one length; 2**31 at most")
    before = F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(max(first, default=0) + 1)])
    return landed(rows.withColumn("id", before[part] + place).drop("__at"), name)


def _passes(rows: DataFrame, level: DataFrame, columns: list[str], step, between: str, name: str) -> DataFrame:
    """``rows`` through one pass per slice of ``level`` (``SLICE`` rows, by id). ``step(table,
    first, last)`` makes the pass; all but the last return rows of schema ``between``."""
    cuts = range(0, max(1, level.count()), SLICE)
    for at in cuts:
        table = level.where((F.col("id") >= at) & (F.col("id") < at + SLICE)).select(*columns).toArrow()
        last = at == cuts[-1]
        rows = landed(map_arrow(rows, step(table, at == 0, last), OCCURRENCES if last else between), name)
    return rows


def _join_sorted(pos, ids, more_pos, more_ids) -> tuple[np.ndarray, np.ndarray]:
    """Two relations over the same positions as one, in order."""
    if not len(pos):
        return more_pos, more_ids
    pos, ids = np.concatenate((pos, more_pos)), np.concatenate((ids, more_ids))
    order = np.argsort(pos, kind="stable")
    return pos[order], ids[order]


def first_occurrences(texts: DataFrame, level: DataFrame) -> DataFrame:
    """``R_1``: frequent words of the texts with their positions."""

    def step(table: pa.Table, first: bool, last: bool):
        ids, of = table["id"].to_numpy().astype(np.int32), {}
        for n, lang in enumerate(table["lang"].to_pylist()):
            of.setdefault(lang, []).append(n)
        words = table["word"].cast(pa.large_binary()).combine_chunks()
        known = {lang: (words.take(pa.array(n)), ids[n]) for lang, n in of.items()}

        def rows_of(batch):
            if first:
                for lang, text in _by_lang(batch):
                    yield lang, text, np.zeros(0, np.int32), np.zeros(0, np.int32)
            else:
                for row in batch.to_pylist():
                    yield row["lang"], row["text"], np.frombuffer(row["pos"], np.int32), np.frombuffer(row["id"], np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, text, pos, found in rows_of(batch):
                    if lang in known:
                        here, at = words_of(text)
                        hit = pc.fill_null(pc.index_in(here, known[lang][0]), -1).to_numpy()
                        pos, found = _join_sorted(pos, found, at[hit >= 0], known[lang][1][hit[hit >= 0]])
                    if last:
                        yield from _stretches(pos, found)
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([text], pa.binary()), *_bytes(pos, found)], ["lang", "text", "pos", "id"])

        return run

    return _passes(texts, level, ["lang", "word", "id"], step, "lang string, text binary, pos binary, id binary", "phrases-r1")


def _stretches(pos: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``R``: a row owns the positions below ``own``; the ``OVERLAP`` positions from
    there belong to the next row and are only there to be joined with."""
    start = 0
    while start < len(pos):
        own = int(pos[start]) + STRETCH
        stop, last = np.searchsorted(pos, [own, own + OVERLAP]).tolist()
        yield _row(own, pos[start:last], ids[start:last])
        start = stop


def _bytes(pos: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    return [pa.array([pos.astype(np.int32).tobytes()]), pa.array([ids.astype(np.int32).tobytes()])]


def _row(own: int, pos: np.ndarray, ids: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    names = ["own", "pos", "id", "next_pos", "next_id"]
    return pa.RecordBatch.from_arrays([pa.array([own]), *_bytes(pos, ids), *more], names[:3 + len(more)])


def _relation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    kinds = None, np.int32, np.int32, np.int32, np.int32
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() if c == 0 else np.frombuffer(batch.column(c)[i].as_buffer(), kinds[c])
                        for c in range(batch.num_columns))


def adjacent(pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The merge-join of a sorted relation with itself at the next position: positions, and
    both numbers as one key (32 bits each)."""
    here = np.flatnonzero(np.diff(pos) == 1)
    return pos[here], ids[here].astype(np.int64) << 32 | ids[here + 1]


def pair_counts(relation: DataFrame) -> DataFrame:
    """Occurrences of each pair of adjacent phrases: ``first``, ``second``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for own, pos, ids in _relation(batches):
            at, keys = adjacent(pos, ids)
            held.append(keys[at < own])
            size += len(held[-1])
            if size > HELD:
                yield _counts(held)
                held, size = [], 0
        if size:
            yield _counts(held)

    counted = map_arrow(relation, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return counted.select(F.shiftright("key", 32).alias("first"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("second"), "n")


def _counts(held: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])


def extend(relation: DataFrame, level: DataFrame, name: str) -> DataFrame:
    """``R_k+1``: adjacent pairs of ``R_k`` semi-joined with ``L_k+1``."""

    def step(table: pa.Table, first: bool, last: bool):
        keys = table["first"].to_numpy() << 32 | table["second"].to_numpy()
        order = np.argsort(keys)
        keys, numbers = keys[order], table["id"].to_numpy()[order].astype(np.int32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, pos, ids, *done in _relation(batches):
                at, pairs = adjacent(pos, ids)
                where = np.searchsorted(keys, pairs)
                hit = np.flatnonzero(where < len(keys))
                hit = hit[keys[where[hit]] == pairs[hit]]
                new = at[hit], numbers[where[hit]]
                if done:
                    new = _join_sorted(*done, *new)
                if not last:
                    yield _row(own, pos, ids, *_bytes(*new))
                elif len(new[0]):
                    yield _row(own, *new)

        return run

    return _passes(relation, level, ["first", "second", "id"], step, f"{OCCURRENCES}, next_pos binary, next_id binary", name)


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, most_words: int = 4,
         inside: tuple[int, int] = (80, 100), scale: int = 2_000_000, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``most_words`` words found ``min_count`` times
    or more: ``lang``, ``rank``, ``phrase``, ``a`` (its count), ``l`` and ``r`` (counts of the
    parts of its lowest-scoring cut), ``n`` (words of the language) and ``score``,
    floor(scale * a / (l + r)). A phrase inside a longer candidate with at least
    ``inside[0] / inside[1]`` of its count is left out."""
    if most_words > OVERLAP + 1:
        raise ValueError(f"phrases of at most {OVERLAP + 1} words")
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                      F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).where(F.length("text") > 0)
    counts = landed(word_counts(texts), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("words"))
    level = numbered(counts.where(F.col("n") >= min_count).select(
        "lang", "word", F.col("word").cast("string").alias("phrase"), "n", F.array("n").alias("starts"), F.array("n").alias("ends")), "phrases-l1")
    relation = first_occurrences(texts, level)
    levels = []
    for k in range(2, most_words + 1):
        a, b = (level.select(F.col("id").alias(c), "lang", "phrase", "starts", "ends") for c in ("first", "second"))
        pairs = pair_counts(relation).where(F.col("n") >= min_count)
        # starts[i] counts the first i+1 words, ends[i] the last i+1
        found = pairs.join(a.drop("ends"), "first").join(
            b.select("second", F.col("phrase").alias("__tail"), F.col("ends")), "second").select(
                "first", "second", "lang", "n", F.concat_ws(" ", "phrase", F.substring_index("__tail", " ", -1)).alias("phrase"),
                F.concat("starts", F.array("n")).alias("starts"), F.concat("ends", F.array("n")).alias("ends"))
        level = numbered(found, f"phrases-l{k}")
        levels.append(level)
        if k < most_words:
            relation = extend(relation, level, f"phrases-r{k}")
    return _ranked(levels, totals, inside, scale, top)


def _ranked(levels: list[DataFrame], totals: DataFrame, inside: tuple[int, int], scale: int, top: int) -> DataFrame:
    out = None
    for k, level in enumerate(levels, 2):
        if k - 1 < len(levels):
            # what is in a longer phrase often enough is also in one that is one word longer
            longer = levels[k - 1]
            over = longer.select(F.col("first").alias("id"), F.col("n").alias("m")).union(longer.select("second", "n"))
            over = over.groupBy("id").agg(F.max("m").alias("m"))
            level = level.join(over, "id", "left").where(
                F.col("m").isNull() | F.expr(f"cast(m as decimal(19,0)) * {inside[1]}BD < cast(n as decimal(19,0)) * {inside[0]}BD"))
        cuts = []
        for i in range(1, k):
            left, right = F.col("starts")[i - 1], F.col("ends")[k - i - 1]
            score = F.expr(f"(cast(n as decimal(19,0)) * {scale}BD) div (cast(starts[{i - 1}] as decimal(19,0)) + ends[{k - i - 1}])")
            cuts.append(F.struct(score.cast("long").alias("score"), F.lit(i).alias("i"), left.alias("l"), right.alias("r")))
        best = level.withColumn("__cut", F.array_min(F.array(*cuts)))
        part = best.select("lang", "phrase", F.col("n").alias("a"), F.col("__cut.l").alias("l"), F.col("__cut.r").alias("r"), F.col("__cut.score").alias("score"))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
