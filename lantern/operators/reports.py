"""Intake reports: drop report (A1), per-source counts (A2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.predicates import py_strip


def ordered_join(items_col: str, order_col: str, sep: str):
    """Aggregate expression: ``items`` joined by ``sep`` in ``order`` order."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                                         F.col(items_col).alias("v")))),
                    lambda s: s["v"]), sep)


def drop_report(dropped: DataFrame, top: int = 6) -> DataFrame:
    """A1: per source, counts by reason class and the first ``top`` distinct
    unmatched titles (case-blind, first spelling kept, arrival order), plus how
    many more distinct titles there were.

    The top-n is a ``row_number <= n`` filter, which Spark plans as a
    per-partition group limit before the shuffle, so a source with millions of
    distinct titles ships at most ``n`` rows per map task.
    """
    counts = dropped.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_dropped"),
        F.count_if(F.col("reason") == "no title term matched").alias("n_no_term"),
        F.count_if(F.col("reason").startswith("title excluded")).alias("n_excluded"))
    counts = counts.withColumn("n_location", F.col("n_dropped") - F.col("n_no_term") - F.col("n_excluded"))

    missed = (dropped.where(F.col("reason") == "no title term matched")
              .withColumn("t", py_strip(F.coalesce("title", F.lit(""))))
              .where(F.col("t") != ""))
    distinct_titles = (missed.groupBy("source", F.lower("t").alias("lt"))
                       .agg(F.min_by("t", "ingest_seq").alias("t"),
                            F.min("ingest_seq").alias("first_seq")))
    n_distinct = distinct_titles.groupBy("source").agg(F.count(F.lit(1)).alias("n_titles"))
    w = Window.partitionBy("source").orderBy("first_seq")
    first = (distinct_titles.withColumn("rn", F.row_number().over(w))
             .where(F.col("rn") <= top)
             .withColumn("t72", F.substring("t", 1, 72))
             .groupBy("source").agg(ordered_join("t72", "rn", " | ").alias("unmatched_titles")))
    out = (counts.join(n_distinct, "source", "left").join(first, "source", "left")
           .select("source", "n_dropped", "n_no_term", "n_excluded", "n_location",
                   F.coalesce("unmatched_titles", F.lit("")).alias("unmatched_titles"),
                   F.greatest(F.coalesce("n_titles", F.lit(0)) - F.lit(top), F.lit(0))
                   .cast("long").alias("more_titles")))
    return out


def source_counts(survivors: DataFrame, scored: DataFrame, key: str = "url") -> DataFrame:
    """A2: surviving postings per source (descending) and how many of them were
    never scored. One left join against the distinct scored keys plus one
    aggregate, so the survivors are computed once."""
    seen = scored.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    return (survivors.join(seen, key, "left")
            .groupBy("source")
            .agg(F.count(F.lit(1)).alias("postings"),
                 F.count_if(F.col("_seen").isNull()).alias("never_scored"))
            .orderBy(F.desc("postings"), "source"))
