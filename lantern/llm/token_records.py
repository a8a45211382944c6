"""Token ids as length-delimited binary records, with a separate offset index.

A record is: length of the payload (8 bytes), masked CRC-32 of those 8 bytes (4), the
payload, masked CRC-32 of the payload (4), and a line feed that ends the record. The
payload is: flags (1 byte; 1: the id is null, 2: ids take 4 bytes instead of 2), the
document id (8 bytes), the token ids. All integers are little-endian.

Documents are range-partitioned and sorted by id, so the files in name order hold them
in ascending order. Spark's text writer stores the records (any bytes; the line feed is
its separator), so files are committed like any other output, a lost executor's attempt
leaves nothing behind, and no Python code opens a path. The index has file, offset,
length, id and token count of every record; a shuffled reader takes its order from the
index and checks both CRCs of every record it reads.

Defined results: null text counts as empty; every document ends with ``end_id``; rows
with the same id are ordered by text, null ids come first; an empty table gives files
without records; extra columns are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import Chunked, pieces
from .common import held, map_arrow

HEAD, TAIL = 12, 5
#: Fixed value: added to a rotated checksum so that a checksum of data that holds
#: checksums stays useful.
MASK = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = len(payload).to_bytes(8, "little")
    return b"".join((n, masked(n).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little"), b"\n"))


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """Offset and payload of each record of a file, checksums verified."""
    at = 0
    while at < len(data):
        head = bytes(data[at:at + HEAD])
        if len(head) < HEAD or masked(head[:8]) != int.from_bytes(head[8:], "little"):
            raise ValueError(f"record at {at}: damaged length")
        n = int.from_bytes(head[:8], "little")
        payload = data[at + HEAD:at + HEAD + n]
        end = bytes(data[at + HEAD + n:at + HEAD + n + TAIL])
        if len(payload) < n or len(end) < TAIL or masked(payload) != int.from_bytes(end[:4], "little"):
            raise ValueError(f"record at {at}: damaged payload")
        yield at, payload
        at += HEAD + n + TAIL


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = len(ids) and ids.max() > 0xFFFF
    flags = (doc_id is None) | wide << 1
    return struct.pack("<Bq", flags, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: memoryview) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


class WordTokenizer:
    """The library's tokenizer, called once per distinct chunk of a batch."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        # ids that end a word: one for each word of letters, so many such words go through one call
        self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.final[i] = token.endswith("</w>")
        self.seen: dict[bytes, bytes] = {}

    def _encode_new(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Distinct chunks with their ids as bytes. Words of ASCII letters are encoded 256 at
        a time, joined by spaces (which the vocabulary drops), and told apart by the ids that
        end a word; where that does not come out even, and for all other chunks, singly."""
        letters = [w for w in words if w.strip().isalpha()]
        single = [w for w in words if not w.strip().isalpha()]
        groups = [letters[at:at + 256] for at in range(0, len(letters), 256)]
        joined = self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)
        for group, coded in zip(groups, joined):
            ids = np.array(coded.ids, np.uint32)
            ends = np.flatnonzero(self.final[ids]) + 1
            if len(ends) != len(group) or (len(ids) and ends[-1] != len(ids)):
                single += group
                continue
            data, ends = ids.tobytes(), (ends * 4).tolist()
            yield from ((w, data[a:b]) for w, a, b in zip(group, [0, *ends], ends))
        for at in range(0, len(single), 4096):
            some = single[at:at + 4096]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            yield from ((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(some, coded))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and each one's n + 1 offsets."""
        ch = Chunked(column, self.specials)
        words, seen = ch.words.to_pylist(), self.seen
        new = [w for w in words if w not in seen]
        if len(seen) + len(new) > 500_000:  # only a cache
            seen.clear()
            new = words
        for at in range(0, len(new), 65_536):
            seen.update(self._encode_new(new[at:at + 65_536]))
        got = [seen[w] for w in words]
        lens = np.fromiter(map(len, got), np.int64, len(got)) // 4
        return ch.gather(np.cumsum(lens) - lens, lens, np.frombuffer(b"".join(got), np.uint32))


#: Text in a batch: beside a full cache of words, every copy of a batch counts.
BATCH_BYTES = 4 << 20


def _tokenizer(path: str) -> WordTokenizer:
    return held(("tokenizer", path), lambda: WordTokenizer(path))


def write_records(df: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                  text_col: str = "text", file_bytes: int = 16 << 20) -> None:
    """Tokenize and write the documents below ``path``, some ``file_bytes`` of text a file."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    # rows of one id, or without one, spread over files by their texts' hash
    docs = docs.withColumn("hash", F.xxhash64("text")).repartitionByRange(max(1, -(-total // file_bytes)), "id", "hash")
    docs = docs.sortWithinPartitions("id", "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                ids, at = tokenizer.encode(piece.column(1))
                out = [frame(pack(i, np.append(ids[a:b], np.uint32(end_id))))[:-1]
                       for i, a, b in zip(piece.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    map_arrow(docs, run, "record binary", BATCH_BYTES).select(F.col("record").cast("string").alias("value")).write.text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    no = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return files.select(no.alias("file_no"), "path", "content")


def read_records(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every record: ``file_no``, ``file``, ``offset``, ``length`` (of the whole record),
    ``file_start`` (ids before it in its file), ``id``, ``n_tokens`` and ``ids``
    (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                start, rows = 0, []
                for at, payload in frames(memoryview(content.as_buffer())):
                    doc_id, ids = unpack(payload)
                    rows.append((no, name, at, HEAD + len(payload) + TAIL, start, doc_id, len(ids), ids.tobytes() if with_ids else b""))
                    start += len(ids)
                    if len(rows) == 2000:
                        yield to_batch(rows)
                        rows = []
                if rows:
                    yield to_batch(rows)

    schema = pa.schema([("file_no", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                        ("file_start", pa.int64()), ("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = map_arrow(
        _files(spark, path), run, "file_no long, file string, offset long, length long, file_start long, id long, n_tokens long, ids binary")
    return out if with_ids else out.drop("ids")


def write_index(spark: SparkSession, records_path: str, index_path: str) -> DataFrame:
    """The offset index of the files, written as Parquet, with ``start``: ids in all
    records before. Positions of files add up block by block of 1,024, so no task sees
    more rows than that, whatever the number of files."""
    records = read_records(spark, records_path, with_ids=False)
    records.write.parquet(f"{index_path}/records")
    records = spark.read.parquet(f"{index_path}/records")
    files = records.groupBy("file_no").agg(F.sum("n_tokens").alias("n")).withColumn(
        "block", F.floor(F.col("file_no") / 1024))
    blocks = files.groupBy("block").agg(F.sum("n").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("block_start"))
    within = Window.partitionBy("block").orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("in_block", F.coalesce(F.sum("n").over(within), F.lit(0))).join(blocks, "block")
    files.select("file_no", (F.col("in_block") + F.col("block_start")).alias("first")).write.parquet(f"{index_path}/files")
    return read_index(spark, index_path)


def read_index(spark: SparkSession, index_path: str) -> DataFrame:
    files = spark.read.parquet(f"{index_path}/files")
    return spark.read.parquet(f"{index_path}/records").join(files, "file_no").withColumn(
        "start", F.col("first") + F.col("file_start")).drop("first")


def shuffled(spark: SparkSession, records_path: str, index: DataFrame, seed: int, parts: int) -> DataFrame:
    """All records in an order set by ``seed``: the index gives each record its place,
    and only places and records, not texts, are shuffled."""
    place = F.xxhash64(F.lit(seed), "file_no", "offset")
    order = index.select("file_no", "offset", "start", place.alias("place"))
    return (read_records(spark, records_path).join(order, ["file_no", "offset"])
            .repartitionByRange(parts, "place").sortWithinPartitions("place", "file_no", "offset").drop("place"))
