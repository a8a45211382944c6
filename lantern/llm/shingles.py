"""Word-shingle sets, MinHash samples and odd sketches of a text column, batch by batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from .chunks import text_bytes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SKETCH_BITS = 512


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes, and n + 1 offsets.
    Words are runs without ASCII white space, A-Z lowered; a document of fewer words
    than ``size`` has its whole word sequence as its one shingle."""
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    solid = ~_SPACE[data]
    fresh = solid.copy()
    fresh[1:] &= ~solid[:-1]
    inside = offsets[:-1][offsets[:-1] < len(data)]
    fresh[inside] = solid[inside]  # a word does not run on from the document before
    starts = np.flatnonzero(fresh)
    before = np.append(0, np.cumsum(solid))
    ends = np.append(before[starts], before[-1]).astype(np.int32)
    letters = np.ascontiguousarray(_LOWER[data[solid]])
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(letters)]).dictionary_encode()
    of_word = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = of_word[coded.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)  # of each document's words

    flat = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        flat = mix((flat ^ words[j:j + len(flat)]) + np.uint64(j + 1))
    sets, lens = [], np.zeros(n, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= size:
            got = np.unique(flat[a:b - size + 1])
        elif b > a:
            one = np.array([b - a], np.uint64)
            for w in words[a:b]:
                one = mix(one ^ w) + np.uint64(0x9E3779B97F4A7C15)
            got = one
        else:
            continue
        sets.append(got)
        lens[i] = len(got)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.append(0, np.cumsum(lens))


def minhashes(flat: np.ndarray, offsets: np.ndarray, samples: int) -> np.ndarray:
    """``samples`` MinHash values (documents x samples) of non-empty sets."""
    rng = np.random.default_rng(20_011)
    keys = rng.integers(0, 1 << 63, (2, samples), dtype=np.uint64)
    out = np.empty((len(offsets) - 1, samples), np.uint64)
    for k in range(samples):
        x = (flat ^ keys[0, k]) * (keys[1, k] | np.uint64(1))
        out[:, k] = np.minimum.reduceat(x ^ x >> np.uint64(31), offsets[:-1])
    return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each ``rows`` samples, different from band to band."""
    bands = samples.shape[1] // rows
    out = np.empty((len(samples), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(samples), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = mix(key ^ samples[:, k]) + np.uint64(k)
        out[:, b] = key
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents x 8 words of 64 bits): each sample flips one bit, so
    samples that two documents share cancel out of the XOR of their bitmaps."""
    n, k = samples.shape
    bit = mix(samples + np.arange(1, k + 1, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    at = (np.arange(n)[:, None] * SKETCH_BITS + bit.astype(np.int64)).ravel()
    odd = (np.bincount(at, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return np.packbits(odd, axis=1).view(np.uint64)


def differing_bits(similarity: float, samples: int) -> float:
    """Expected population count of the XOR of two odd sketches at a similarity."""
    flips = 2 * samples * (1 - similarity)
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)


def parities(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A parity bitmap of each whole set, of a power of two of bits that is no smaller
    than the set (512 at least). Elements that two sets share cancel out, and the XOR
    of two bitmaps never has more bits than their sets have elements apart."""
    bits, out = mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        size = max(512, 1 << max(0, b - a - 1).bit_length())
        odd = np.bincount((bits[a:b] & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of elements that two sets do not share, from their
    parities. The longer bitmap is folded to the shorter one's length."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a) * 8, len(b) * 8
    while n > m:
        n //= 2
        x = x >> n ^ x & (1 << n) - 1
    while m > n:
        m //= 2
        y = y >> m ^ y & (1 << m) - 1
    return (x ^ y).bit_count()
