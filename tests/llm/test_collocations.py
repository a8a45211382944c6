import re
from collections import Counter

import numpy as np
from plain import SF, ascii_lower

from lantern.llm import collocations as C
from lantern.llm.queries import op13_collocations


def plain(rows, min_count, top):
    """The contract in Python: rows of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", ascii_lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    found = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    gone = set()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = (lang, words[i:i + k])
                if 100 * a >= 80 * found[inner]:
                    gone.add(inner)
    out = {}
    for (lang, words), a in found.items():
        if (lang, words) not in gone:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
    return {(lang, r): (p.decode(), -a, x, y, n[lang], -s) for lang, got in out.items()
            for r, (s, a, p, x, y) in enumerate(sorted(got)[:top], 1)}


def result(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def test_whole_table_against_plain_statement(spark):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(rows, 30, 2000)
    assert result(op13_collocations(spark, SF)) == want and want


AWKWARD = [("Red Apple pie, red apple PIE; red\tapple pie. red apple tart", "en"), (None, "en"), ("", None), ("x y x y x y x y", None),
           ("Été à la été à la\nété à la", "fr"), ("red apple pie", "en"), ("red apple pie", "en"), ("a" * 70_000, "en"),
           (". , ; : ! ?\n\x0b\x0c\r", "en"), ("no go " * 30_000, "zz"), ("x y x y", "und"), ("z w z w z w", "fr")]


def awkward(spark):
    return spark.createDataFrame([(t, la, i, 1) for i, (t, la) in enumerate(AWKWARD)], "text string, lang string, rank int, phrase int")


def test_awkward_rows(spark):
    for min_count, top in ((2, 2000), (3, 4)):
        assert result(C.mine(awkward(spark), min_count=min_count, top=top)) == plain(AWKWARD, min_count, top)
    assert C.mine(awkward(spark).limit(0)).count() == 0
    assert C.mine(awkward(spark), min_count=10 ** 6).count() == 0


def test_slices_and_stretches_change_nothing(spark, monkeypatch):
    """Several passes over the occurrences, and stretches of a few words."""
    want = plain(AWKWARD, 2, 2000)
    monkeypatch.setattr(C, "SLICE", 3)
    monkeypatch.setattr(C, "STRETCH", 5000)
    monkeypatch.setattr(C, "HELD", 100)
    assert result(C.mine(awkward(spark), min_count=2)) == want


def test_words_and_positions():
    words, pos = C.words_of(b"A b.c  d,\n e")
    assert words.to_pylist() == [b"a", b"b", b"c", b"d", b"e"] and np.diff(pos).tolist() == [1, 2, 1, 3]
    at, keys = C.adjacent(np.array([0, 1, 3, 4, 5]), np.array([7, 8, 9, 1, 2], np.int32))
    assert at.tolist() == [0, 3, 4][:0] + [0, 3, 4][0:1] + [3, 4] and keys.tolist() == [7 << 32 | 8, 9 << 32 | 1, 1 << 32 | 2]
