"""Keep-first de-duplication (D1, D2) and the posting intake plan built on it.

Keep-first is ``min(ingest_seq)`` per key rather than a ``row_number`` window: the
aggregate is split partial/final, so a key holding a third of all rows is reduced
to one narrow row per map task before the shuffle, while a window would sort that
whole key in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.predicates import py_strip
from lantern.operators.filters import BILLED_SOURCES, company_block, routed_rule


def keep_first(df: DataFrame, keys: list, order: str = "ingest_seq") -> DataFrame:
    """First row (smallest ``order``, which is unique) of each key; ``keys`` are names
    or Columns. Only keys and ``order`` are aggregated; the rows that stay are found by
    a semi join, so a plan that needs few columns reads and moves no others."""
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(keys)]
    first = df.groupBy(*named).agg(F.min(order).alias("_first")).select("_first")
    return df.join(first, F.col(order) == F.col("_first"), "left_semi")


def role_key_company() -> Column:
    return F.lower(py_strip(F.coalesce(F.col("company"), F.lit(""))))


def role_key_title() -> Column:
    return F.lower(py_strip(F.coalesce(F.col("title"), F.lit(""))))


def dedupe_posting_key(postings: DataFrame) -> DataFrame:
    """First per (source, company, posting_id) in arrival order."""
    return keep_first(postings, ["source", "company", "posting_id"])


def dedupe_role(postings: DataFrame, sources=BILLED_SOURCES) -> DataFrame:
    """For the billed sources, first per (source, lower trim company,
    lower trim title); other sources pass untouched (and are not shuffled)."""
    billed = F.col("source").isin(list(sources))
    rest = postings.where(~billed | F.col("source").isNull())
    once = keep_first(postings.where(billed),
                      [F.col("source"), role_key_company(), role_key_title()])
    return rest.unionByName(once)


def role_duplicates(postings: DataFrame, sources=BILLED_SOURCES) -> DataFrame:
    """D2 counts: per billed source, rows kept and same-role duplicates removed."""
    billed = postings.where(F.col("source").isin(list(sources)))
    per_role = (billed.groupBy("source", role_key_company().alias("c"), role_key_title().alias("t"))
                .agg(F.count(F.lit(1)).alias("n")))
    return (per_role.groupBy("source")
            .agg(F.count(F.lit(1)).alias("kept"),
                 (F.sum("n") - F.count(F.lit(1))).cast("long").alias("duplicates")))


def collect_postings(postings: DataFrame, keywords, locations, excludes,
                     blocked_companies=None) -> DataFrame:
    """The intake plan: P6 company block -> D1 -> P5 per-source rule -> D2.

    One filter pass evaluates every source's rule; only billed rows go through
    the second (role) dedupe shuffle.
    """
    p = company_block(postings, blocked_companies)
    p = dedupe_posting_key(p)
    p = p.where(routed_rule(keywords, locations, excludes))
    return dedupe_role(p)


def narrow_survivors(postings: DataFrame, keywords, locations, excludes, blocked_companies=None, columns=("url",)) -> DataFrame:
    """``source``, ``ingest_seq`` and ``columns`` of the rows that ``collect_postings``
    keeps, for reports that need no whole posting: both keep-first steps carry the narrow
    columns of the first row through the aggregate, so the postings are read once and no
    row is looked up again. Rows of sources that are not billed are roles of their own."""
    p = company_block(postings, blocked_companies)
    first = p.groupBy("source", "company", F.col("posting_id").alias("_id")).agg(
        F.min(F.struct("ingest_seq", "title", "location", *columns)).alias("_r"))
    p = first.select("source", "company", "_r.*").where(routed_rule(keywords, locations, excludes))
    billed = F.coalesce(F.col("source").isin(list(BILLED_SOURCES)), F.lit(False))
    role = [F.when(billed, role_key_company()).alias("_c"), F.when(billed, role_key_title()).alias("_t"),
            F.when(~billed, F.col("ingest_seq")).alias("_own")]
    once = p.groupBy("source", *role).agg(F.min(F.struct("ingest_seq", *columns)).alias("_r"))
    return once.select("source", "_r.*")
