import zlib
from collections import Counter

import pytest
from plain import SF
from pyspark.sql import functions as F

from lantern.llm import language_id as L
from lantern.llm.queries import op3_language_id


def phrases(text, sample):
    """Cross parsing as it is defined: the longest phrase found in the sample, again and again."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


SAMPLE = {"aa": "the cat sat on the mat and the hat", "bb": "der hund und die katze und der hut"}


def test_phrases_against_plain_parsing():
    parser = L.CrossParser(SAMPLE)
    texts = ["the cat", "DER Hund!! und 12 katze", "xyz qqq", "a", "the hat and the cat sat " * 9, "é der é"]
    got, lens = parser.phrases(texts)
    import re
    for text, counts, n in zip(texts, got, lens):
        norm = re.sub(r"[\W\d_]+", " ", text.lower())
        assert n == len(norm)
        for lang, count in zip(parser.langs, counts):
            windows = [norm[i:i + L.WINDOW] for i in range(0, len(norm), L.WINDOW)]
            assert count == sum(phrases(w, SAMPLE[lang]) for w in windows), (text, lang)


def test_suffix_automaton_accepts_exactly_the_substrings():
    text = "abcbcabbca"
    step = L.suffix_automaton([ord(c) - 97 for c in text])

    def accepts(word):
        state = 0
        for c in word:
            state = step[state].get(ord(c) - 97)
            if state is None:
                return False
        return True

    import itertools
    for n in range(1, 5):
        for word in map("".join, itertools.product("abc", repeat=n)):
            assert accepts(word) == (word in text)
    assert len(step) <= 2 * len(text)


def test_large_alphabets_take_memory_by_arcs():
    """Five languages of 12,000 characters over 4,000 letters each; dense tables took 3 GB for four."""
    import random
    rng = random.Random(3)
    sample = {f"l{k}": "".join(chr(0x4E00 + 500 * k + int(4000 * rng.random() ** 3)) for _ in range(12_000)) for k in range(5)}
    parser = L.CrossParser(sample)
    assert parser.owner.nbytes + parser.to.nbytes + parser.start.nbytes + parser.alone.nbytes < 16 << 20
    texts = [sample["l1"][4000:4200], sample["l3"][50:90] + "x" + sample["l3"][7000:7100], "", "abc"]
    got, _ = parser.phrases(texts)
    for text, counts in zip(texts, got):
        assert counts.tolist() == [phrases(text, sample[x]) for x in parser.langs]
    assert parser.predict(texts[:2])[0] == ["l1", "l3"]


def test_held_out_accuracy_on_the_whole_table(spark):
    rows = op3_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    hits = Counter()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        hits[r.held_out, r.lang_pred == lang[r.doc_id]] += 1
    assert hits[True, True] / (hits[True, True] + hits[True, False]) >= 0.99


def test_training_never_sees_held_out_rows_or_more_than_its_bound(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    sample = L.training_sample(df.where(~L.held_out()), chars_per_lang=3000, chars_per_row=100)
    assert set(sample) == {"de", "en", "es", "fr"} and all(1000 < len(t) <= 3000 for t in sample.values())
    texts = "\n".join(r[0] for r in df.where(~L.held_out()).select("text").collect())
    assert all(line in texts for t in sample.values() for line in t.split("\n")[:-1])


def test_awkward_rows(awkward):
    df = awkward.withColumn("score", F.lit("mine"))
    out = L.identify(df, SAMPLE)
    assert out.columns == ["doc_id", "text", "n_lines", "key", "lang_pred", "score", "phrase_chars"]
    got = {r.key: r for r in out.collect()}
    assert len(got) == 11
    for k in (1, 3, 6, 10):  # null, empty, blank, null
        assert (got[k].lang_pred, got[k].score, got[k].phrase_chars) == ("und", 0.0, 0.0)
    assert got[8].lang_pred in SAMPLE and L.identify(df.limit(0), SAMPLE).count() == 0
    assert {r.lang_pred for r in L.identify(df, {}).collect()} == {"und"}


def test_tie_goes_to_the_first_language():
    assert L.CrossParser({"b": "same text", "a": "same text"}).predict(["same"])[0] == ["a"]
    assert L.CrossParser({"b": "same text"}).predict(["same"])[1].tolist() == [1.0]


def test_untaught_labels(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (3, "12 34", "en")], "doc_id long, text string, lang string")
    assert L.training_sample(df) == {}


def test_filter_drops_only_foreign_text(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "кот сидел на ковре и шляпе"), (3, None), (4, "12")], "doc_id long, text string")
    assert [r.doc_id for r in L.drop_unidentified(df, SAMPLE).collect()] == [1]
