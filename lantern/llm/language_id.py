"""Language ID by cross-parsing entropy.

Each language has a suffix automaton of a bounded sample of its labelled text. A text is
parsed against it from left to right into the longest phrases that occur in the sample;
few phrases mean that the language's text predicts it well. The number of phrases times
log2 of the sample's length, over the text's length, estimates the cross entropy in bits
per character; the language with the smallest wins. ``score`` is 1 minus the smallest
estimate over the next one (1 if there is one language). Letters are lower-cased, and a
run of anything else counts as one character, so marks and digits tell nothing.

Texts are parsed in windows of ``WINDOW`` characters, each from the automaton's root, so
that a task walks all windows of a batch through all automata side by side; every window
of a text counts, however long it is.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go to
the language that sorts first; characters outside the sample's alphabet are phrases of
their own; without any labelled text every row is ``und``; an empty table gives no rows;
other columns pass through, and input columns named like the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .chunks import pieces
from .common import held, map_arrow

UND = "und"
WINDOW = 256
OUT = ("lang_pred", "score", "phrase_chars")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id's text divides by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                    chars_per_lang: int = 12_000, chars_per_row: int = 400) -> dict[str, str]:
    """At most ``chars_per_lang`` characters of each language from labelled rows, at most
    ``chars_per_row`` of one, taken in the order of a hash of the id. Rows are ranked by
    that hash per map task first (a bounded heap per language), so the driver gets
    ``chars_per_lang`` characters per language and no more, whatever the table's size."""
    rows_per_lang = max(1, chars_per_lang // 100)  # short rows leave room for more
    labelled = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.substring(text_col, 1, chars_per_row).alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    ranked = labelled.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    sample: dict[str, list[str]] = {}
    for lang, text in ranked.where(F.col("r") <= rows_per_lang).orderBy("lang", "r").select("lang", "text").toLocalIterator():
        got = sample.setdefault(lang, [])
        if sum(map(len, got)) < chars_per_lang:
            got.append(text)
    return {lang: "\n".join(texts)[:chars_per_lang] for lang, texts in sample.items()}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Arcs (symbol to state) of each state of a sequence's suffix automaton; the root is
    state 0. States are added one symbol at a time; a state whose suffixes would differ is
    split."""
    size = 2 * max(1, len(codes))
    link, length = [-1] * size, [0] * size
    arcs: list[dict[int, int]] = [{}]
    last = 0
    for c in codes:
        new = len(arcs)
        arcs.append({})
        length[new] = length[last] + 1
        at = last
        while at >= 0 and c not in arcs[at]:
            arcs[at][c] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            to = arcs[at][c]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                twin = len(arcs)
                arcs.append(dict(arcs[to]))
                length[twin], link[twin] = length[at] + 1, link[to]
                while at >= 0 and arcs[at].get(c) == to:
                    arcs[at][c] = twin
                    at = link[at]
                link[to] = link[new] = twin
        last = new
    return arcs


def interleave(arcs: list[dict[int, int]], sigma: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arcs of all states in one array: the arc of state s by symbol c lies at
    ``start[s] + c``, if ``owner`` is s there. Rows are shifted until they fit between each
    other, the fullest first, so the array is about as long as there are arcs, whatever the
    size of the alphabet."""
    total = sum(map(len, arcs))
    owner, to = np.full(total * 2 + 2 * sigma, -1, np.int32), np.zeros(total * 2 + 2 * sigma, np.int32)
    start, free = np.zeros(len(arcs), np.int32), bytearray(b"\1") * len(owner)
    hint = lowest = 0
    for s in sorted((s for s in range(len(arcs)) if arcs[s]), key=lambda s: -len(arcs[s])):
        symbols = sorted(arcs[s])
        # rows of several arcs go on where the last one went; single arcs fill what they left
        at = max(hint if len(symbols) > 1 else lowest, symbols[0])
        while True:
            at = free.find(1, at)
            if at < 0 or at - symbols[0] + sigma > len(free):  # full: make it longer
                more = len(free)
                at = more + symbols[0] if at < 0 else at
                free += bytearray(b"\1") * (more + sigma)
                owner, to = (np.concatenate((x, np.full(more + sigma, -1, np.int32))) for x in (owner, to))
            shift = at - symbols[0]
            if all(free[shift + c] for c in symbols):
                break
            at += 1
        start[s] = shift
        for c, target in arcs[s].items():
            free[shift + c], owner[shift + c], to[shift + c] = 0, s, target
        if len(symbols) > 1:
            hint = max(hint, at - 256)
        else:
            lowest = at
    return start, owner, to


class CrossParser:
    """The automata of all languages, built from their samples, in one array of arcs."""

    def __init__(self, sample: dict[str, str]):
        self.langs = sorted(sample)
        texts = [" ".join(re.findall(r"[^\W\d_]+", sample[x].lower())) for x in self.langs]
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])
        alphabet = sorted({ch for t in texts for ch in t} - {" "})
        sigma = len(alphabet) + 2  # code 0: any other letter; code 1: whatever is no letter
        of = {" ": 1} | {ch: i + 2 for i, ch in enumerate(alphabet)}
        self.code = np.array([of.get(ch.lower(), 0) if (ch := chr(i)).isalpha() else 1 for i in range(0x110000)], np.int32)
        # Where a state has no arc the phrase ends, and the next begins with the character:
        # ``alone`` is the state after it by itself. One more state of each language follows
        # a character that the language does not have; nothing goes on from it.
        # Languages are laid out one after the other, so one automaton at a time is in Python.
        self.roots, self.alone = [], np.zeros((len(texts), sigma), np.int32)
        parts, states, places = [], 0, 0
        for n, t in enumerate(texts):
            arcs = suffix_automaton([of[ch] for ch in t])
            alone = np.full(sigma, len(arcs), np.int32)
            for c, to in arcs[0].items():
                alone[c] = to
            arcs[0] = dict(enumerate(alone.tolist()))  # nothing ends at the root
            start, owner, to = interleave([*arcs, {}], sigma)
            parts.append((start + places, np.where(owner < 0, -1, owner + states).astype(np.int32), to + states))
            self.alone[n] = alone + states
            self.roots.append(states)
            states, places = states + len(start), places + len(owner)
        self.start, self.owner, self.to = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (zip(*parts) if parts else ((), (), ())))
        self.start = self.start.astype(np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text under each language (texts x languages), and the lengths
        parsed."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        codes = self.code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(codes), bool)  # a run of non-letters counts as one
        keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
        keep[(np.cumsum(lens) - lens)[lens > 0]] = True
        left = np.append(0, np.cumsum(keep))
        codes, lens = codes[keep], np.diff(left[np.append(0, np.cumsum(lens))])
        windows = -(-lens // WINDOW)
        doc = np.repeat(np.arange(len(texts)), windows)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = np.repeat(np.cumsum(lens) - lens, windows) + nth * WINDOW
        size = np.minimum(WINDOW, lens[doc] - nth * WINDOW)
        order = np.argsort(-size, kind="stable")
        start, size, doc = start[order], size[order], doc[order]
        states = np.repeat(np.array(self.roots, np.int32)[:, None], len(doc), 1)
        ends = np.ones((len(self.langs), len(doc)), np.int32)  # the phrase that the window's end cuts
        active = np.searchsorted(-size, -np.arange(1, WINDOW + 1), side="right")
        for t in range(WINDOW):
            n = active[t]
            if not n:
                break
            here, now = codes[start[:n] + t], states[:, :n]
            at = self.start[now] + here
            ended = self.owner[at] != now
            ends[:, :n] += ended
            states[:, :n] = np.where(ended, self.alone[:, here], self.to[at])
        out = np.stack([np.bincount(doc, weights=e, minlength=len(texts)) for e in ends], 1) if len(self.langs) else np.zeros((len(texts), 0))
        return out, lens

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and mean phrase length (characters) under that language."""
        n, lens = self.phrases(texts)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        rate = n * self.bits / np.maximum(lens, 1)[:, None]
        best = rate.argmin(1)
        rows = np.arange(len(texts))
        score = np.ones(len(texts))
        if len(self.langs) > 1:
            two = np.partition(rate, 1, axis=1)
            score = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-12)
        return [self.langs[i] for i in best], np.clip(score, 0, 1), lens / np.maximum(n[rows, best], 1)


def parser_in_task(sample: tuple) -> CrossParser:
    """Automata are rebuilt from the small sample once per Python worker."""
    return held(("languages", sample), lambda: CrossParser(dict(sample)))


def identify(df: DataFrame, sample: dict[str, str], text_col: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` and ``phrase_chars``, the mean length of the
    phrases under that language (0 for ``und``)."""
    rest = [c for c in df.columns if c not in OUT]
    model = tuple(sorted(sample.items()))
    lettered = "__lettered"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = parser_in_task(model)
        for batch in batches:
            for piece in pieces(batch, text_col, 2 << 20):
                at = [i for i, ok in enumerate(piece.column(len(rest)).to_pylist()) if ok]
                langs, score, phrase = [UND] * piece.num_rows, np.zeros(piece.num_rows), np.zeros(piece.num_rows)
                if at:
                    texts = piece.column(rest.index(text_col)).take(pa.array(at)).to_pylist()
                    got, score[at], phrase[at] = parser.predict(texts)
                    for i, lang in zip(at, got):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:len(rest)], pa.array(langs), pa.array(score), pa.array(phrase)], [*rest, *OUT])

    schema = StructType([*df.select(*rest).schema, StructField("lang_pred", StringType()),
                         StructField("score", DoubleType()), StructField("phrase_chars", DoubleType())])
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias(lettered)
    return map_arrow(df.select(*rest, has_letter), run, schema)


def drop_unidentified(df: DataFrame, sample: dict[str, str], text_col: str = "text", min_phrase: float = 1.5) -> DataFrame:
    """``df`` without the rows that are in no learned language: ``und``, or parsed into
    phrases of under ``min_phrase`` characters on average, as other scripts are (each
    foreign letter is a phrase of its own; text of a learned language has 4 and more)."""
    out = identify(df, sample, text_col)
    return out.where((F.col("lang_pred") != UND) & (F.col("phrase_chars") >= min_phrase)).select(*df.columns)
