"""Streams that go on where they ended (X1, X2), isolated scorer failures (M6), and
readers over landed files (S7, R19, R21, R22)."""

import os
from datetime import datetime, timezone

from pyspark.sql import functions as F

from lantern.operators import link, runlogs, scoring, tracker
from lantern.operators.dedupe import collect_postings
from lantern.operators.records import read_record_lines
from lantern.sources.mail import parse_message, read_mail
from lantern.streaming import intake
from tests.conftest import rows

POSTING = ("ingest_seq long, source string, company string, title string, location string, url string, "
           "description_html string, posting_id string")


POSTING_COLUMNS = [x.split()[0] for x in POSTING.split(", ")]


def _run(spark, tmp_path, work):
    scored = spark.createDataFrame([("u9",)], "url string")
    return intake.incremental_intake(
        spark, f"{tmp_path}/landed", spark.createDataFrame([], POSTING).schema, lambda b: b,
        ["kiln"], [], [], [], scored, f"{tmp_path}/{work}")


def _land(spark, tmp_path, data):
    spark.createDataFrame([(i, "lever", "Kestrel", f"Kiln {i}", "Leeds", u, "", p) for i, u, p in data], POSTING) \
        .coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")


def test_two_runs_equal_one_run_over_both(spark, tmp_path):
    _land(spark, tmp_path, [(1, "u1", "a"), (2, "u2", "b"), (3, "u9", "c")])
    assert sorted(rows(_run(spark, tmp_path, "night"), "ingest_seq")) == [(1,), (2,)]
    _land(spark, tmp_path, [(4, "u4", "a"), (5, "u5", "d")])  # posting a is stored already
    two = sorted(rows(_run(spark, tmp_path, "night"), "ingest_seq"))
    assert two == [(1,), (2,), (5,)] == sorted(rows(_run(spark, tmp_path, "both"), "ingest_seq"))
    assert sorted(rows(_run(spark, tmp_path, "night"), "ingest_seq")) == two  # nothing new


def test_null_and_role_keys_over_runs_equal_one_run(spark, tmp_path):
    """Keys with nulls, a key whose first row the rules drop, and roles of a billed source."""
    def land(*data):
        spark.createDataFrame([(i, s, c, t, "Leeds", f"u{i}", "", p) for i, s, c, t, p in data], POSTING) \
            .coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")

    nights = [
        [(1, "lever", None, "Kiln", "a"), (2, "lever", None, "Kiln", "a"), (3, "lever", "K", "Kiln", None), (4, "lever", "D", "Other", "d")],
        [(5, "lever", None, "Kiln", "a"), (6, "lever", "K", "Kiln", None), (7, "lever", "D", "Kiln", "d"), (8, "linkedin", "K", "Kiln Hand", "x")],
        [(9, "linkedin", " k ", "KILN hand", "y"), (10, "linkedin", None, "Kiln Hand", "z"), (11, None, "K", "Kiln", "q")],
    ]
    for night in nights:
        land(*night)
        got = sorted(rows(_run(spark, tmp_path, "night"), "ingest_seq"))
    assert got == sorted(rows(_run(spark, tmp_path, "once"), "ingest_seq"))
    batch = collect_postings(spark.read.parquet(f"{tmp_path}/landed"), ["kiln"], [], [], [])
    assert got == sorted(rows(batch, "ingest_seq"))
    assert (1,) in got and (3,) in got and not {(2,), (5,), (6,), (7,)} & set(got)
    again = _run(spark, tmp_path, "night")
    assert again.columns == POSTING_COLUMNS and sorted(rows(again, "ingest_seq")) == got


def test_replayed_epoch_adds_no_row(spark, tmp_path):
    table = f"{tmp_path}/table"
    batch = spark.createDataFrame([(1,), (2,)], "id int")
    assert intake._stored(spark, table) is None
    for _ in range(2):
        intake._write_epoch(batch, table, 0)
    intake._write_epoch(batch.where("id = 2"), table, 1)
    assert intake._stored(spark, table).count() == 3 and intake._stored(spark, table, before=1).count() == 2


def test_one_raising_posting_is_one_failure(spark):
    def scorer(pdf):
        if "bad" in set(pdf["title"]):
            raise ValueError("no answer")
        if "key" in set(pdf["title"]):
            raise scoring.KeyRefused("401")
        return pdf[["posting_id"]].assign(score=7, error=None)

    schema = "posting_id string, score double, error string"
    df = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y")], "posting_id string, title string").coalesce(1)
    ok, failed = scoring.split_failures(scoring.apply_scorer(df, scorer, schema))
    assert sorted(rows(ok, "posting_id")) == [("a",), ("c",)] and rows(failed, "posting_id", "error") == [("b", "ValueError: no answer")]
    df = spark.createDataFrame([("a", "bad"), ("b", "key"), ("c", "y")], "posting_id string, title string").coalesce(1)
    got = dict(rows(scoring.apply_scorer(df, scorer, schema), "posting_id", "error"))
    assert got == {"a": "ValueError: no answer", "b": "refused: 401", "c": "refused: 401"}
    assert scoring.refused(scoring.apply_scorer(df, scorer, schema)).count() == 2


def test_employer_named_late_in_a_long_body_is_found(spark):
    body = "filler words " * 600 + "regards from Kestrel Tiles, we regret to inform you"
    m = spark.createDataFrame([(1, "x@example.org", "hello", body, datetime(2024, 1, 9))],
                              "msg_id long, sender string, subject string, body string, date timestamp")
    a = spark.createDataFrame([(7, "Kestrel Tiles", "Kiln Planner", "", "2024-01-02")],
                              "row_seq long, company string, title string, url string, date_submitted string")
    assert rows(link.reply_candidates(m, a), "msg_id", "row_seq") == [(1, 7)]
    assert rows(m.select(link.classify().alias("v"), link.classify(max_chars=4000).alias("w")), "v", "w") == [("rejected", None)]


def test_reason_is_read_whole(spark):
    line = "[warn] ashby/kestrel failed: " + "x" * 70 + " 404"
    lines = spark.createDataFrame([(f"f{d}", datetime(2024, 1, d), 0, line) for d in (1, 2, 3)],
                                  "file string, mtime timestamp, line_no int, line string")
    (r,) = runlogs.source_failures(lines, "2024-01-04", 7).collect()
    assert (r.kind, r.level, len(r.why)) == ("dead", "FAIL", 60)


RAW = (b"From: =?utf-8?q?J=C3=B8rn?= <jorn@example.org>\r\nSubject: two\r\n lines\r\nDate: Sun, 31 Dec 2023 21:00:00 -0500\r\n"
       b"Message-ID: <m1@x>\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<p>a &amp; b</p>  \r\n")


def test_mail_dates_are_utc_wherever_the_worker_is(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("TZ", "America/New_York")
    import time
    time.tzset()
    try:
        got = parse_message(RAW, "f")
    finally:
        monkeypatch.undo()
        time.tzset()
    assert got == ("<m1@x>", "Jørn <jorn@example.org>", "two lines", "a & b", datetime(2024, 1, 1, 2, tzinfo=timezone.utc), None)
    os.makedirs(f"{tmp_path}/box/in")
    for name, raw in (("a.eml", RAW), ("b.eml", b"\r\n"), ("c.eml", b"Date: never\r\nContent-Type: text/plain; charset=nope\r\n\r\nhi")):
        with open(f"{tmp_path}/box/in/{name}", "wb") as f:
            f.write(raw)
    got = sorted(rows(read_mail(spark, f"{tmp_path}/box"), "subject", "body", "error"))
    assert got == [("", "", None), ("", "hi", None), ("two lines", "a & b", None)]


def test_lines_keep_their_numbers(spark, tmp_path):
    for name in ("one", "two"):
        with open(f"{tmp_path}/{name}.log", "w") as f:
            f.write("first\n\nthird\n")
    assert sorted(rows(runlogs.read_run_logs(spark, str(tmp_path)), "file", "line_no", "line")) == [
        (f"{n}.log", i, t) for n in ("one", "two") for i, t in enumerate(["first", "", "third"])]
    assert sorted(rows(read_record_lines(spark, f"{tmp_path}/one.log"), "line_no", "line")) == [(0, "first"), (1, ""), (2, "third")]


def test_tracker_keeps_order_and_any_cell(spark, tmp_path):
    cells = ['a "quoted" cell', "back\\slash\"", "two\nlines", " spaces ", ""]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "row_seq long, title string")
    for c in tracker.FIELDS:
        if c != "title":
            df = df.withColumn(c, F.lit("x"))
    tracker.write_tracker(df.repartition(3), f"{tmp_path}/t")
    assert sorted(rows(tracker.read_tracker(spark, f"{tmp_path}/t"), "row_seq", "title")) == list(enumerate(cells))
