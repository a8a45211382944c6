"""Line dedup: drop the lines that many documents share (DataFrame functions only).

Every document is exploded to its lines, a line's normalised key is hashed to 128
bits, documents per hash are counted, and the positions whose hash is frequent are
taken out of the document again. Three shuffles: distinct keys per document (partial
counts before the shuffle, so the commonest line costs one row per map task), line
positions against the frequent hashes (a semi join that AQE can split where one hash
is hot), and dropped positions back to their documents.

Defined results:
- a null text counts as empty; an empty text is one empty line and stays empty;
- an empty key (blank line) is never dropped unless ``min_chars`` is 0;
- every row is a document: rows that repeat a ``doc_id`` count as often as they occur;
- a line that occurs twice in one document counts once for it, and both go;
- an empty table gives an empty table; other columns pass through unchanged, and
  input columns named ``n_lines`` or ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, ascii_lower, digest128, landed


def line_keys(text: Column) -> Column:
    """Normalised keys of the lines of ``text``, in line order."""
    return F.transform(F.split(ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(WS)))


def frequent_keys(df: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """128-bit hashes (``h1``, ``h2``) of the keys found in ``min_docs`` rows or more."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = df.select(F.explode(F.array_distinct(line_keys(text))).alias("key"))
    h1, h2 = digest128(F.col("key"))
    return (keys.where(F.char_length("key") >= min_chars)
            .select(h1.alias("h1"), h2.alias("h2"))
            .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
            .where(F.col("n_docs") >= min_docs).select("h1", "h2"))


def drop_common_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``df`` with the common lines taken out of ``text_col``, plus ``n_lines`` (before
    dropping) and ``n_dropped``."""
    out = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = digest128(F.col(id_col), F.col(text_col))
    keyed = df.select(*out, k1.alias("__k1"), k2.alias("__k2"))

    lines = keyed.select("__k1", "__k2", F.posexplode(line_keys(text)).alias("pos", "key"))
    h1, h2 = digest128(F.col("key"))
    lines = lines.where(F.char_length("key") >= min_chars).select(
        "__k1", "__k2", "pos", h1.alias("h1"), h2.alias("h2"))
    # landed, so that the join reads two plain exchanges and a hot line can be split
    common = landed(frequent_keys(df, text_col, min_docs, min_chars), "frequent-lines")
    # collect_set: identical rows share their key, and the set never outgrows one document
    dropped = (lines.join(common, ["h1", "h2"], "left_semi")
               .groupBy("__k1", "__k2").agg(F.collect_set("pos").alias("__drop")))

    # the join stands between the split and its uses, so no line array is built per element
    cut = keyed.join(dropped, ["__k1", "__k2"], "left").withColumn("__lines", F.split(text, "\n", -1))
    n = F.size("__lines")
    kept = F.array_except(F.sequence(F.lit(0), n - 1), F.col("__drop"))
    kept_text = F.array_join(F.transform(kept, lambda i: F.col("__lines")[i]), "\n")
    cut = cut.withColumn("__kept", F.when(F.col("__drop").isNull(), text).otherwise(kept_text))
    return cut.select(*[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in out],
                      n.alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).alias("n_dropped"))
