"""A minimal acyclic transducer from words to token ids, and exact merges for the rest.

States that accept the same suffixes with the same outputs are shared. An arc carries
the number of words that sort before it in its state, so the sum along a path is the
word's rank, and the ids of all words lie in rank order in one array. The automaton, the
ids and the tokenizer's merges are plain arrays in one file that readers memory-map.
"""

from __future__ import annotations

import json
import mmap
from functools import cached_property, lru_cache

import numpy as np
import regex

from .chunks import spread

#: The pre-tokenizer pattern of the byte-level vocabulary, with its white
#: space (the Unicode property White_Space) spelled out.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable
    Latin-1 characters for themselves, then code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def read_vocabulary(path: str) -> dict[str, np.ndarray]:
    """Arrays of a byte-level BPE file: bytes of each id, id of each byte, merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, chars = spec["model"]["vocab"], byte_chars()
    added = {t["id"]: t["content"] for t in spec["added_tokens"]}
    size = max([*vocab.values(), *added]) + 1
    of = [b""] * size
    for token, i in vocab.items():
        of[i] = bytes(chars[c] for c in token) if i not in added else b""
    for i, text in added.items():
        of[i] = text.encode()
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    merges = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
    lens = np.array([len(x) for x in of], np.int64)
    by_byte = {b: vocab[c] for c, b in chars.items()}
    return {"token_bytes": np.frombuffer(b"".join(of), np.uint8), "token_ends": np.cumsum(lens), "merges": merges.ravel(),
            "byte_ids": np.array([by_byte[b] for b in range(256)], np.int64), "special_ids": np.array(sorted(added), np.int64)}


def special_tokens(arrays: dict[str, np.ndarray]) -> dict[bytes, list[int]]:
    ends, data = np.asarray(arrays["token_ends"]), np.asarray(arrays["token_bytes"])
    return {data[ends[i - 1] if i else 0:ends[i]].tobytes(): [i] for i in np.asarray(arrays["special_ids"]).tolist()}


class Merger:
    """Byte-pair merges of single pre-tokens, lowest rank first."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        merges = np.asarray(arrays["merges"]).reshape(-1, 3).tolist()
        self.rank = {a << 32 | b: r for r, (a, b, _) in enumerate(merges)}
        self.made = [c for _, _, c in merges]
        self.byte_ids = np.asarray(arrays["byte_ids"]).tolist()
        self.specials = special_tokens(arrays)
        self.pretoken = lru_cache(1 << 15)(self._merge)

    def word(self, chunk: bytes) -> list[int]:
        """Ids of a chunk."""
        if chunk in self.specials:
            return self.specials[chunk]
        body = chunk[1:] if chunk[:1] == b" " else chunk
        if body.isalpha():  # ASCII letters: one pre-token
            return self._merge(chunk)
        out: list[int] = []
        for token in PATTERN.findall(chunk.decode()):
            out += self.pretoken(token.encode())
        return out

    def _merge(self, token: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in token]
        if len(ids) > 48:
            return self._merge_long(ids)
        rank, none = self.rank.get, 1 << 60
        ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i:i + 2] = [self.made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for very long pre-tokens."""
        import heapq

        n, rank = len(ids), self.rank.get
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = self.made[r], False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (q := rank(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, alive) if ok]


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of sorted, distinct words: each state's arcs in byte order
    with the weight that adds up to a word's rank. Built from the words' last bytes
    backwards: the states along the previous word that the next word leaves are closed,
    deepest first, and an equal closed state is used instead where there is one."""
    register: dict[tuple, int] = {}
    closed: list[tuple] = []   # (final, ((byte, target), ...)) of each closed state
    count: list[int] = []      # words accepted from each closed state
    path: list[list] = [[False, []]]  # open states along the last word: final, arcs

    def close(state: list) -> int:
        key = (state[0], tuple(state[1]))
        if key not in register:
            register[key] = len(closed)
            closed.append(key)
            count.append(int(key[0]) + sum(count[t] for _, t in key[1]))
        return register[key]

    last = b""
    for word in [*words, None]:
        shared = 0
        if word is not None:
            while shared < min(len(last), len(word)) and last[shared] == word[shared]:
                shared += 1
        for depth in range(len(last), shared, -1):
            target = close(path.pop())
            path[-1][1].append((last[depth - 1], target))
        if word is None:
            break
        path += [[False, []] for _ in word[shared:]]
        path[-1][0] = True
        last = word
    root = close(path.pop())
    keys, targets, weights = [], [], []
    for state, (final, arcs) in enumerate(closed):
        below = int(final)
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            weights.append(below)
            below += count[target]
    return {"arc": np.array(keys, np.int64), "target": np.array(targets, np.int32), "weight": np.array(weights, np.int32),
            "final": np.array([f for f, _ in closed], np.uint8), "root": np.array([root], np.int64)}


def build(words: list[bytes], vocabulary: dict[str, np.ndarray]) -> bytes:
    """The lexicon file of ``words`` under a vocabulary."""
    merger, words = Merger(vocabulary), sorted(set(words))
    ids = [merger.word(w) for w in words]
    arrays = compile_words(words) | vocabulary
    arrays["id_ends"] = np.cumsum([len(x) for x in ids], dtype=np.int64)
    arrays["ids"] = np.array([i for x in ids for i in x], np.uint32)
    head, body, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, at, len(a)]
        body.append(raw + b"\0" * (-len(raw) % 8))
        at += len(body[-1])
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(body)


class Lexicon:
    """A memory-mapped lexicon file: the transducer for frequent words, merges for others."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        a = {k: np.frombuffer(self.map, t, m, 8 + n + at) for k, (t, at, m) in json.loads(self.map[8:8 + n]).items()}
        self.arc, self.target, self.weight, self.final, self.root = (a[k] for k in ("arc", "target", "weight", "final", "root"))
        self.ids, self.id_lens = a["ids"], np.diff(a["id_ends"], prepend=0)
        self.id_starts = a["id_ends"] - self.id_lens
        self.token_bytes, self.token_lens = a["token_bytes"], np.diff(a["token_ends"], prepend=0)
        self.token_starts = a["token_ends"] - self.token_lens
        self.arrays = a
        self.specials = tuple(special_tokens(a))
        self.seen: dict[bytes, np.ndarray] = {}

    @cached_property
    def merger(self) -> Merger:
        """Built where words are encoded; decoding does without."""
        return Merger(self.arrays)

    def ranks(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The rank of each word, or -1: all words walk the automaton side by side."""
        n = len(offsets) - 1
        out = np.full(n, -1, np.int64)
        if not n or not len(self.arc):
            return out
        starts, lens = offsets[:-1].astype(np.int64), np.diff(offsets)
        live, state, rank, step = np.arange(n), np.full(n, self.root[0], np.int64), np.zeros(n, np.int64), 0
        while len(live):
            over = lens[live] == step
            ends = live[over]
            ok = self.final[state[over]] == 1
            out[ends[ok]] = rank[over][ok]
            live, state, rank = live[~over], state[~over], rank[~over]
            key = state << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            ok = self.arc[at] == key
            live, at = live[ok], at[ok]
            state, rank, step = self.target[at].astype(np.int64), rank[ok] + self.weight[at], step + 1
        return out

    def encode_words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a binary array: each word's start and length in a flat array of ids."""
        from .chunks import text_bytes

        rank = self.ranks(*text_bytes(words))
        rest = np.flatnonzero(rank < 0)
        lens = np.where(rank < 0, 0, self.id_lens[rank] if len(self.id_lens) else 0)
        starts = np.where(rank < 0, 0, self.id_starts[rank] if len(self.id_starts) else 0)
        if not len(rest):
            return starts, lens, self.ids
        if len(self.seen) > 50_000:  # only a cache of words merged before
            self.seen.clear()
        seen, merge, got = self.seen, self.merger.word, []
        for w in words.take(rest).to_pylist():
            ids = seen.get(w)
            if ids is None:
                ids = np.array(merge(w), np.uint32).tobytes()
                if len(w) <= 32:
                    seen[w] = ids
            got.append(ids)
        n = np.fromiter(map(len, got), np.int64, len(got)) // 4
        lens[rest], starts[rest] = n, len(self.ids) + np.cumsum(n) - n
        return starts, lens, np.concatenate([self.ids, np.frombuffer(b"".join(got), np.uint32)])

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after another, and each id's end."""
        return spread(self.token_starts, self.token_lens, self.token_bytes, ids)
