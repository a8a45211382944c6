"""Streaming queries (X1, X2): the documents / conversations files streamed
with ``availableNow`` through the batch operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lantern.plans import q_intake, q_linkage
from lantern.plans.registry import register
from lantern.plans.settings import BLOCKED_COMPANIES, EXCLUDES, KEYWORDS, LOCATIONS
from lantern.plans.tables import ADAPTERS, adapter, read_table, run_sql
from lantern.session import checkpoint_dir
from lantern.streaming.intake import incremental_intake, late_mail


def _work(spark, name):
    """A first run each time: the query has no earlier night to go on from."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("X1_incremental_intake", oracle=q_intake.ORACLES_J1 if hasattr(q_intake, "ORACLES_J1") else None)
def x1(spark, sf):
    docs = read_table(spark, sf, "documents")

    def to_postings(batch):
        return run_sql(spark, sf, ADAPTERS["postings"], documents=batch)

    out = incremental_intake(spark, f"{sf}/documents.parquet", docs.schema, to_postings,
                             KEYWORDS, LOCATIONS, EXCLUDES, BLOCKED_COMPANIES, adapter(spark, sf, "scored"),
                             _work(spark, "intake"))
    return out.select("ingest_seq", "source", "url")


@register("X2_late_mail", oracle=q_linkage.SQL_CANDIDATES.replace("{msgs}", "{messages}"))
def x2(spark, sf):
    conv = read_table(spark, sf, "conversations")

    def to_messages(batch):
        return run_sql(spark, sf, ADAPTERS["messages"], conversations=batch).withColumn(
            "date", F.col("date").cast("timestamp"))

    return late_mail(spark, f"{sf}/conversations.parquet", conv.schema, to_messages,
                     adapter(spark, sf, "applications"), _work(spark, "mail"))
