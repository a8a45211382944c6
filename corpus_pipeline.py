"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, BPE encoding.

``STAGES`` are applied in order; each one's rows are written as Parquet to the shared
folder and read again as the next one's ``docs``, so a lost executor costs no more than
the stage it was in. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.llm import bpe, language_id
from lantern.llm.common import landed, table_path
from lantern.llm.decontaminate import drop_contaminated
from lantern.llm.line_dedup import drop_common_lines
from lantern.llm.near_dup import drop_near_duplicates
from lantern.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the labelled ones teach go."""
    sample = language_id.training_sample(docs.where(~language_id.held_out()))
    return language_id.drop_unidentified(docs, sample)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a document stays, with what is left."""
    out = drop_common_lines(docs, min_docs=10, min_chars=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with 80 % of their five-word shingles in common stays."""
    return drop_near_duplicates(docs).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(table_path(sf_dir, "benchmark"))).select(*docs.columns)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and their digest and that of the text they decode to."""
    lexicon = bpe.build_lexicon(docs, tokenizer_path("byte_bpe_50k.json"))
    out = bpe.decode(bpe.encode(docs.select("doc_id", "text"), lexicon), lexicon)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("line_dedup", drop_lines), ("near_dup", drop_near_copies),
          ("decontamination", drop_benchmark), ("bpe", encode_text)]

#: No SQL for suffix automata, edit distance or BPE; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
