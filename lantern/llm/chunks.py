"""Text columns as distinct chunks, for tokenizers that work word by word.

A chunk is a stretch of text that a pre-tokenizer never joins with its neighbours, so
its token ids do not depend on them: a new chunk starts where white space follows
something else, and between ASCII (or Latin-1) letters, digits and punctuation. Where
that is not certain (an apostrophe, other scripts, Unicode spaces, combining marks) no
chunk is started, which costs nothing but a longer chunk. Each distinct chunk of a batch
is then encoded once and the ids are gathered back into document order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, PUNCT, OTHER = range(5)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for i in range(33, 127):
        ch = chr(i)
        table[i] = LETTER if ch.isalpha() else DIGIT if ch.isdigit() else OTHER if ch == "'" else PUNCT
    table[list(b" \t\n\x0b\x0c\r")] = SPACE
    return table


_CLASS = _classes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its n + 1 offsets (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``max_bytes`` of text, a document at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _starts(data: np.ndarray) -> np.ndarray:
    cls = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1 letters, without the signs for times and divided by
    lead = lead[~np.isin(data[lead + 1], (0x97, 0xB7))]
    cls[lead] = cls[lead + 1] = LETTER
    before, here = cls[:-1], cls[1:]
    new = np.zeros(len(data), bool)
    plain = (before != OTHER) & (here != OTHER) & (before != SPACE) & (here != SPACE) & (before != here)
    new[1:] = plain | ((here == SPACE) & (before != SPACE))
    # white space after a character that may itself be a Unicode space: leave it joined
    for back, leads in ((2, (0xC2,)), (3, (0xE1, 0xE2, 0xE3))):
        at = np.flatnonzero(np.isin(data, leads)) + back
        new[at[at < len(data)]] = False
    return new


class Chunked:
    """The chunks of a text column: ``words`` distinct (binary array), ``index`` of each
    chunk, ``first`` the first chunk of each document (n + 1)."""

    def __init__(self, column: pa.Array, specials: tuple[bytes, ...] = ()):
        data, offsets = text_bytes(column)
        new = _starts(data) if len(data) > 1 else np.zeros(len(data), bool)
        if specials and len(data):
            self._cut_specials(data, offsets, new, specials)
        inside = offsets[offsets < len(data)]
        new[inside] = True
        at = np.flatnonzero(new)
        self.first = np.searchsorted(at, offsets)
        ends = np.append(at, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        self.words = coded.dictionary
        self.index = coded.indices.to_numpy(zero_copy_only=False) if len(at) else np.zeros(0, np.int64)

    @staticmethod
    def _cut_specials(data, offsets, new, specials):
        """A special token's string is a chunk of its own, as the library finds it before anything else."""
        for m in re.finditer(b"|".join(map(re.escape, specials)), data.tobytes()):
            lo, hi = m.span()
            if np.searchsorted(offsets, lo, side="right") == np.searchsorted(offsets, hi - 1, side="right"):
                new[lo:hi] = False
                new[lo] = True
                if hi < len(new):
                    new[hi] = True

    def gather(self, starts: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values in document order, from each word's slice of ``flat``; and each
        document's n + 1 offsets into them."""
        n = lens[self.index]
        ends = np.cumsum(n)
        where = np.repeat(starts[self.index] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return flat[where], np.append(0, ends)[self.first]


def spread(starts: np.ndarray, lens: np.ndarray, flat: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` that ``picks`` names, one after another, and each one's end."""
    n = lens[picks]
    ends = np.cumsum(n)
    where = np.repeat(starts[picks] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    return flat[where], ends
