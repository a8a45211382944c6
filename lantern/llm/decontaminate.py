"""Benchmark decontamination by pigeonhole edit matching.

An item of n characters may be found with up to k = floor(``error_rate`` * n) edits.
Cut into k + 1 pieces, at least one piece of any such occurrence is untouched, so every
occurrence lies around an exact hit of a piece. All pieces are searched for at once (an
Aho-Corasick automaton per task), and each hit's neighbourhood is verified with Myers'
bit-parallel edit distance, the item as pattern and free ends in the text. Both sides
are lower-cased, and runs of white space count as one space.

Documents are read in place (nothing is shuffled); a document's hits lie in its own row,
so copies and hot sources spread over tasks as the input does. The items are the stated
query set: they go to the tasks in blocks of ``block_chars`` characters, one pass over
the documents per block, so neither a task nor the driver holds more than a block.

Defined results: null, empty and blank items match nothing, nor does a null text; items
under ``1 / error_rate`` characters must match exactly; equal items match alike, each
under its own id; an item found several times in a document gives one row with the
smallest distance, ties to the leftmost end; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, map_arrow

ERROR_RATE = 0.05


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def cut(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length, with their positions."""
    n, parts = len(item), errors + 1
    at = [n * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:])]


class Pattern:
    """Myers' bit-vectors of one item."""

    def __init__(self, item: str):
        self.n = len(item)
        self.full = (1 << self.n) - 1
        self.top = 1 << (self.n - 1)
        self.eq: dict[str, int] = {}
        for i, ch in enumerate(item):
            self.eq[ch] = self.eq.get(ch, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """The smallest distance of the item to a substring, and its first end."""
        eq, full, top = self.eq.get, self.full, self.top
        up, down, score = full, 0, self.n  # vertical differences of +1 and of -1
        least, end = self.n, 0
        for j, ch in enumerate(text, 1):
            same = eq(ch, 0)
            diag = (((same & up) + up) ^ up) | same | down
            plus, minus = down | (full & ~(diag | up)), up & diag
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus, minus = plus << 1 & full, minus << 1 & full
            up, down = minus | (full & ~(diag | plus)), plus & diag
            if score < least:
                least, end = score, j
        return least, end


class Matcher:
    """All items of a block: one automaton over the distinct pieces."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, (item_id, text) in enumerate(items):
            item = normalise(text)
            if not item:
                continue
            errors = int(error_rate * len(item))
            self.items[key] = (item_id, item, errors, Pattern(item))
            for at, piece in cut(item, errors):
                pieces.setdefault(piece, []).append((key, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item found."""
        if not self.items:
            return []
        spans: dict[int, list[list[int]]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for key, at in uses:
                _, item, errors, _ = self.items[key]
                start = last - size + 1 - at  # where the item would begin without edits
                lo, hi = max(0, start - errors), min(len(text), start + len(item) + errors)
                got = spans.setdefault(key, [])
                if got and lo <= got[-1][1] and hi >= got[-1][0]:  # they overlap: one stretch
                    got[-1][0], got[-1][1] = min(got[-1][0], lo), max(got[-1][1], hi)
                else:
                    got.append([lo, hi])
        out = []
        for key, windows in spans.items():
            item_id, item, errors, pattern = self.items[key]
            best = None
            for lo, hi in _merged(windows):
                if best is not None and best[0] == 0:
                    break
                exact = text.find(item, lo, hi)
                got = (0, exact + len(item)) if exact >= 0 else pattern.best(text[lo:hi])
                if exact < 0:
                    got = (got[0], lo + got[1])
                if got[0] <= errors and (best is None or got < best):
                    best = got
            if best is not None:
                out.append((item_id, *best))
        return out


def _merged(windows: list[list[int]]) -> list[list[int]]:
    """Stretches that do not overlap, in order: every character is read once per item,
    however often a repeated passage hits."""
    out: list[list[int]] = []
    for lo, hi in sorted(windows):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def matcher_in_task(key: str, shared, error_rate: float) -> Matcher:
    """A block's matcher, built once per Python worker."""
    return held(("items", key), lambda: Matcher(shared.value, error_rate))


def _shared(spark, items: DataFrame, id_col: str, text_col: str, error_rate: float, block_chars: int):
    """Each block as a broadcast (at most ``block_chars`` characters, or one item), with
    a key that names its content."""
    for block in _blocks(items, id_col, text_col, block_chars):
        key = hashlib.md5(repr((error_rate, block)).encode()).hexdigest()
        yield spark.sparkContext.broadcast(block), key


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks, fetched one block at a time."""
    size = F.coalesce(F.char_length(text_col), F.lit(0))
    keyed = items.where(F.char_length(F.trim(text_col)) > 0).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), size.alias("size"))
    total = keyed.agg(F.sum("size")).head()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = keyed if n == 1 else keyed.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b)
        yield sorted(((r[0], r[1]) for r in part.select("id", "text").collect()), key=lambda r: (r[0] is None, r))


def find_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text_col: str = "text",
               item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE,
               block_chars: int = 4_000_000) -> DataFrame:
    """One row per document and item found in it: ``doc_id``, ``item_id``, ``distance``
    and ``end_char``, where the best occurrence ends in the normalised text."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(narrow.dtypes)["doc_id"]
    found = []
    for shared, key in _shared(docs.sparkSession, items, item_id, item_text, error_rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = matcher_in_task(key, shared, error_rate)
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column(1)):
                    got = matcher.find(normalise(text.as_py() or ""))
                    rows += [i] * len(got)
                    hits += got
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array([h[k] for h in hits], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32())))],
                    ["doc_id", "item_id", "distance", "end_char"])

        found.append(map_arrow(narrow, run, f"doc_id {kind}, item_id long, distance int, end_char int"))
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", error_rate: float = ERROR_RATE, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` without the documents in which an item is found: rows are dropped where
    they are read, so no id and no join is needed."""
    out, at = docs, docs.columns.index(text_col)
    for shared, key in _shared(docs.sparkSession, items, item_id, item_text, error_rate, block_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            matcher = matcher_in_task(key, shared, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normalise(t.as_py() or "")) for t in batch.column(at)], pa.bool_()))

        out = map_arrow(out, run, docs.schema)
    return out
