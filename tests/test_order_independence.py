"""Order independence: the same input spread over other partitions gives the
same answer (keep-first, best/runner-up, word budget, streaks)."""

from lantern.operators import dedupe, link, runlogs, shape
from lantern.plans.settings import BLOCKED_COMPANIES, EXCLUDES, KEYWORDS, LOCATIONS
from lantern.plans.tables import adapter
from tests.conftest import SF001


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_intake_plan(spark):
    p = adapter(spark, SF001, "postings")
    one = dedupe.collect_postings(p, KEYWORDS, LOCATIONS, EXCLUDES, BLOCKED_COMPANIES).select("ingest_seq")
    other = dedupe.collect_postings(p.repartition(7), KEYWORDS, LOCATIONS, EXCLUDES, BLOCKED_COMPANIES) \
        .select("ingest_seq")
    assert same(one, other)


def test_reply_best(spark):
    m, a = adapter(spark, SF001, "messages"), adapter(spark, SF001, "applications")
    one = link.best_and_runner_up(link.reply_candidates(m, a))
    other = link.best_and_runner_up(link.reply_candidates(m.repartition(7), a.repartition(5)))
    assert same(one, other)


def test_word_budget_and_streaks(spark):
    from pyspark.sql import functions as F
    b = shape.role_positions(adapter(spark, SF001, "resume_bullets"), "role_date")
    other = adapter(spark, SF001, "resume_summary").select("resume_id", F.lit(50).alias("words"))
    one = shape.word_budget(shape.cap_bullets(b), other).select("resume_id", "role_pos", "bullet_idx")
    two = shape.word_budget(shape.cap_bullets(b.repartition(7)), other).select("resume_id", "role_pos", "bullet_idx")
    assert same(one, two)
    logs = adapter(spark, SF001, "log_lines")
    assert same(runlogs.source_failures(logs, "2024-02-01", 7), runlogs.source_failures(logs.repartition(7),
                                                                                          "2024-02-01", 7))
