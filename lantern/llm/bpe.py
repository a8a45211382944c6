"""BPE encoding and decoding through a memory-mapped word lexicon.

The chunks (words) of all documents are counted; those frequent enough are compiled with
their ids into a minimal acyclic transducer (``lexicon.py``), a file in the shared folder
that Spark hands to every executor and tasks memory-map. Words it does not hold are
merged exactly, so the result never depends on which words are in it.

Defined results: null text counts as empty; an empty text has no ids and decodes to the
empty string; the string of a special token in a text is that token, as the library has
it; ids decode to the bytes of their tokens, read as UTF-8 with errors replaced; an
empty table gives no rows; other columns pass through, and input columns named ``ids`` or
``decoded`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .chunks import Chunked, pieces, text_bytes
from .common import fresh_dir, held, landed, map_arrow
from .lexicon import Lexicon, build, read_vocabulary

#: Words of more bytes are not worth an entry; they are merged.
MAX_WORD_BYTES = 32
#: Text or ids in a batch; the JVM and the worker hold several copies.
BATCH_BYTES = 2 << 20


def lexicon_in_task(name: str) -> Lexicon:
    """The executor's copy of a lexicon file, mapped once per Python worker."""
    return held(("lexicon", name), lambda: Lexicon(SparkFiles.get(name)))


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (bytes) and ``n`` over all documents, words of up to 32 bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def emit():
            t = pa.concat_tables(held).group_by("word").aggregate([("n", "sum")])
            return [b for b in t.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(50_000)]

        for batch in batches:
            for piece in pieces(batch, text_col):
                ch = Chunked(piece.column(0))
                n = pa.array(np.bincount(ch.index, minlength=len(ch.words)).astype(np.int64))
                short = pa.compute.less_equal(pa.compute.binary_length(ch.words), MAX_WORD_BYTES)
                held.append(pa.table({"word": ch.words, "n": n}).filter(short))
                rows += len(held[-1])
                if rows > 400_000:
                    yield from emit()
                    held, rows = [], 0
        if held:
            yield from emit()

    import pyarrow.compute  # noqa: F401

    return map_arrow(df.select(text_col), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, max_words: int) -> list[bytes]:
    """All words above the lowest count (in steps of an eighth of a power of two) that
    leaves ``max_words`` at most. Only a histogram and those words come to the driver."""
    step = F.floor(F.log2("n") * 8)
    bars = counts.groupBy(step.alias("bar")).agg(F.count("*").alias("words")).collect()
    total, lowest = 0, None
    for bar, words in sorted(bars, reverse=True):
        total += words
        if total > max_words:
            break
        lowest = bar
    if lowest is None:
        return []
    return [bytes(r[0]) for r in counts.where(step >= lowest).select("word").collect()]


def build_lexicon(df: DataFrame, tokenizer_path: str, text_col: str = "text", max_words: int = 1 << 16) -> str:
    """Count words, compile the frequent ones, and hand the file to all executors.
    Returns the file's name for ``encode`` and ``decode``."""
    spark = df.sparkSession
    words = frequent_words(landed(word_counts(df, text_col), "word-counts"), max_words)
    return ship(spark, build(words, read_vocabulary(tokenizer_path)))


def ship(spark: SparkSession, content: bytes) -> str:
    path = fresh_dir(spark, "lexicon")
    one = spark.createDataFrame([(bytearray(content),)], "content binary")
    one.select(F.col("content").cast("string").alias("value")).coalesce(1).write.text(path)
    file = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path").head()[0]
    spark.sparkContext.addFile(file)
    return file.rsplit("/", 1)[-1]


def _with(schema: StructType, *fields: StructField) -> StructType:
    names = {f.name for f in fields}
    return StructType([f for f in schema if f.name not in names] + list(fields))


def encode(df: DataFrame, lexicon: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` without its text, with ``ids``: little-endian unsigned 32-bit integers."""
    rest = [c for c in df.columns if c not in (text_col, ids_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon_in_task(lexicon)
        for batch in batches:
            for piece in pieces(batch, text_col, 2 << 20):
                ch = Chunked(piece.column(len(rest)), lex.specials)
                ids, at = ch.gather(*lex.encode_words(ch.words))
                out = pa.Array.from_buffers(pa.large_binary(), piece.num_rows, [
                    None, pa.py_buffer(np.ascontiguousarray(at.astype(np.int64) * 4)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([*piece.columns[:len(rest)], out.cast(pa.binary())], [*rest, ids_col])

    schema = _with(df.select(*rest).schema, StructField(ids_col, BinaryType()))
    return map_arrow(df.select(*rest, text_col), run, schema, BATCH_BYTES)


def decode(df: DataFrame, lexicon: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids."""
    rest = [c for c in df.columns if c != out_col]
    at_ids = rest.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon_in_task(lexicon)
        for batch in batches:
            for piece in pieces(batch, ids_col, 2 << 20):
                data, offsets = text_bytes(piece.column(at_ids))
                raw, ends = lex.decode(np.frombuffer(data.tobytes(), "<u4"))
                cut = np.append(0, ends)[offsets // 4]
                buf = raw.tobytes()
                texts = [buf[a:b].decode("utf-8", "replace") for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], [*rest, out_col])

    return map_arrow(df.select(*rest), run, _with(df.select(*rest).schema, StructField(out_col, StringType())), BATCH_BYTES)
