import os
import zlib

import numpy as np
import pytest
from plain import AWKWARD, SF
from pyspark.sql import functions as F

from lantern.llm import token_records as T
from lantern.llm.common import fresh_dir
from lantern.llm.queries import op1_token_records, tokenizer_path


@pytest.fixture(scope="module")
def library():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def test_query_against_the_library(spark, documents, library):
    got = {r.doc_id: r for r in op1_token_records(spark, SF).collect()}
    start = 0
    for d in sorted(documents):
        ids = [*library.encode(documents[d], add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(documents)


def test_awkward_rows_index_and_shuffled_read(spark, awkward, library):
    path = fresh_dir(spark, "records")
    T.write_records(awkward, f"{path}/data", tokenizer_path("word_bpe_49k.json"), end_id=1, file_bytes=50_000)
    index = T.write_index(spark, f"{path}/data", f"{path}/index")
    rows = sorted(index.collect(), key=lambda r: r.start)
    want = sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.id for r in rows] == [i for i, _ in want]
    lens = [len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in want]
    assert [r.n_tokens for r in rows] == lens and [r.start for r in rows] == [sum(lens[:i]) for i in range(len(lens))]
    assert index.select("file").distinct().count() > 1
    # the index leads to the record
    r = next(r for r in rows if r.id == 12)
    with open(r.file.removeprefix("file:"), "rb") as f:
        f.seek(r.offset)
        (at, payload), = T.frames(memoryview(f.read(r.length)))
    assert T.unpack(payload)[1].tolist() == [*library.encode("Été É é ß 中文 🙂", add_special_tokens=False).ids, 1]
    one, two = ([r.id for r in T.shuffled(spark, f"{path}/data", index, seed, 2).collect()] for seed in (1, 2))
    assert one != two and sorted(map(str, one)) == sorted(map(str, two)) == sorted(str(i) for i, _ in AWKWARD)


def test_frames_round_trip_and_damage():
    payloads = [T.pack(None, np.array([], np.uint32)), T.pack(-5, np.array([10, 65535])), T.pack(6, np.array([10, 70_000]))]
    data = b"".join(map(T.frame, payloads))
    got = [T.unpack(p) for _, p in T.frames(memoryview(data))]
    assert [(i, ids.tolist()) for i, ids in got] == [(None, []), (-5, [10, 65535]), (6, [10, 70_000])]
    for at in (3, 9, 14, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(T.frames(memoryview(bytes(broken))))
    with pytest.raises(ValueError):
        list(T.frames(memoryview(data[:-1])))


def test_empty_table(spark, awkward):
    path = fresh_dir(spark, "records")
    T.write_records(awkward.where(F.lit(False)), f"{path}/data", tokenizer_path("word_bpe_49k.json"), end_id=1)
    assert T.read_records(spark, f"{path}/data").count() == 0
    assert T.write_index(spark, f"{path}/data", f"{path}/index").count() == 0
