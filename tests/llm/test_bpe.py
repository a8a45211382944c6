import hashlib
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import AWKWARD, SF

from lantern.llm import bpe
from lantern.llm.chunks import Chunked
from lantern.llm.lexicon import Lexicon, build, compile_words, read_vocabulary
from lantern.llm.queries import op6_bpe, tokenizer_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def lexicon(vocabulary, tmp_path_factory):
    path = tmp_path_factory.mktemp("lex") / "words"
    path.write_bytes(build([b" the", b"the", b" and", b" thing", b"ing", b"a", b"."], vocabulary))
    return Lexicon(str(path))


def encode(lexicon, texts):
    ch = Chunked(pa.array(texts, pa.string()), lexicon.specials)
    ids, at = ch.gather(*lexicon.encode_words(ch.words))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


PIECE = st.sampled_from(["a", "B", "the", " the", " and", "'s", "'ll", "'", " ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\x1c",
                         "é", "É", "×", "́", "²", "9", "12", ".", "!?", "<|endoftext|>", "<|", "中", "🙂", "ж", "\x85", "don't", "²9"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=12).map("".join), max_size=5))
def test_any_text_encodes_as_the_library_does(library, lexicon, texts):
    assert encode(lexicon, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_any_unicode_round_trips(lexicon, texts):
    for text, ids in zip(texts, encode(lexicon, texts)):
        raw, _ = lexicon.decode(np.array(ids, np.int64))
        assert raw.tobytes().decode() == text


def test_long_pretokens(library, lexicon):
    texts = ["x" * 5000, "abc" * 3000, "ü" * 999, "ab" * 30 + " " + "ba" * 30]
    assert encode(lexicon, texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(max_size=6), max_size=40))
def test_automaton_ranks_words_and_shares_suffixes(vocabulary, tmp_path_factory, words):
    path = tmp_path_factory.mktemp("lex") / "words"
    words = sorted(words)
    arrays = compile_words(words)
    reached = set()
    for rank, word in enumerate(words):
        state, total = int(arrays["root"][0]), 0
        for byte in word:
            at = int(np.searchsorted(arrays["arc"], state << 8 | byte))
            assert arrays["arc"][at] == state << 8 | byte
            state, total = int(arrays["target"][at]), total + int(arrays["weight"][at])
        assert arrays["final"][state] and total == rank
    # minimal: no two states accept the same suffixes
    arcs = {}
    for key, target in zip(arrays["arc"].tolist(), arrays["target"].tolist()):
        arcs.setdefault(key >> 8, []).append((key & 255, target))
    states = [(int(f), tuple(arcs.get(i, ()))) for i, f in enumerate(arrays["final"])]
    assert len(set(states)) == len(states)


def test_query_against_the_library(spark, documents, library):
    got = {r.doc_id: r for r in op6_bpe(spark, SF).collect()}
    assert len(got) == len(documents)
    for d, text in documents.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 3, 1000])
def test_awkward_rows_whatever_the_lexicon(spark, awkward, library, words):
    name = bpe.build_lexicon(awkward, tokenizer_path("byte_bpe_50k.json"), max_words=words)
    out = bpe.decode(bpe.encode(awkward.withColumnRenamed("n_lines", "ids"), name), name)
    assert out.columns == ["doc_id", "key", "ids", "decoded"]
    for r in out.collect():
        text = AWKWARD[r.key][1] or ""
        assert r.decoded == text and np.frombuffer(r.ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_damaged_ids_decode_with_replacement(spark, awkward, library):
    name = bpe.build_lexicon(awkward, tokenizer_path("byte_bpe_50k.json"), max_words=10)
    ids = library.encode("é🙂", add_special_tokens=False).ids[:-1]
    df = spark.createDataFrame([(bytearray(np.array(ids, "<u4").tobytes()),), (None,)], "ids binary")
    assert {r.decoded for r in bpe.decode(df, name).collect()} == {library.decode(ids, skip_special_tokens=False), ""}


def test_frequent_words_stay_within_the_bound(spark):
    counts = spark.createDataFrame([(bytearray(bytes([97 + i])), 2 ** i) for i in range(10)], "word binary, n long")
    assert set(bpe.frequent_words(counts, 4)) == {b"g", b"h", b"i", b"j"}
    assert bpe.frequent_words(counts, 0) == [] and len(bpe.frequent_words(counts, 99)) == 10
    assert bpe.frequent_words(counts.limit(0), 5) == []
