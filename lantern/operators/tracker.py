"""Tracker and scored-table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unseen(postings: DataFrame, scored: DataFrame, key: str = "url") -> DataFrame:
    """Postings whose ``key`` was never scored (left anti join).

    No broadcast hint: the scored history grows without bound, so the join
    strategy is left to AQE, which switches to a broadcast at run time only
    when the measured side is small.
    """
    return postings.join(scored.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def skipped_count(postings: DataFrame, scored: DataFrame, key: str = "url") -> DataFrame:
    """J1 count: how many postings were skipped as already scored."""
    return (postings.join(scored.select(key).distinct(), key, "left_semi")
            .agg(F.count(F.lit(1)).alias("skipped")))


# ---------------------------------------------------------------------------
# Tracker table: generated columns refreshed every run, user columns carried.
# ---------------------------------------------------------------------------

# Tracker column order (generated, then the user's own).
GENERATED = ["score", "overqualified", "salary", "company", "title", "location",
             "source", "url", "resume", "cover_letter", "first_seen", "last_seen"]
USER = ["status", "date_submitted", "follow_up", "contact", "notes"]
FIELDS = GENERATED + USER
VANISHED_MARK = "[no longer listed"
TERMINAL_STATUSES = ("interview", "offer", "rejected", "passed", "closed", "screening")


def _s(c) -> "F.Column":
    """A tracker cell: text, never null."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def salary_label(low: str = "salary_low", high: str = "salary_high"):
    """``$160K-$253K`` when the high end is set (and non-zero), else ''."""
    lo = F.floor(F.col(low) / 1000).cast("long").cast("string")
    hi = F.floor(F.col(high) / 1000).cast("long").cast("string")
    return (F.when(F.col(high).isNotNull() & (F.col(high) != 0),
                   F.concat(F.lit("$"), lo, F.lit("K-$"), hi, F.lit("K")))
            .otherwise(F.lit("")))


def relative_path(col: str, root: str):
    """A path under ``root`` made relative to it, otherwise its file name;
    blank stays blank."""
    p = F.coalesce(F.col(col), F.lit(""))
    prefix = root.rstrip("/") + "/"
    return (F.when(p == "", F.lit(""))
            .when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30))
            .otherwise(F.element_at(F.split(p, "/"), -1)))


def latest_by_url(tracker: DataFrame, order: str = "row_seq") -> DataFrame:
    """R22 keying: blank urls ignored, last row wins on a repeated url.

    ``max_by`` is a partial/final aggregate, so a hot url cannot pile up in
    one task.
    """
    cols = [c for c in tracker.columns]
    return (tracker.where(F.col("url").isNotNull() & (F.col("url") != ""))
            .groupBy("url")
            .agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_r"))
            .select("_r.*"))


def _prior(tracker: DataFrame) -> DataFrame:
    """The previous row of each url: ``_p_<field>`` for every field, and ``_had_prior``."""
    return latest_by_url(tracker).select(F.col("url").alias("_p_url"), F.lit(True).alias("_had_prior"),
                                         *[F.col(c).alias(f"_p_{c}") for c in FIELDS if c != "url"])


def _refreshed(today: str, project_root: str) -> dict:
    """Cells of a scored posting's row, its previous row (if any) beside it."""
    return {
        "score": _s("score"),
        "overqualified": F.when(F.coalesce(F.col("overqualification_risk"), F.lit(False)), F.lit("yes")).otherwise(F.lit("")),
        "salary": salary_label(), "company": _s("company"),
        "title": F.regexp_replace(_s("title"), "(?U)^\\s+|\\s+$", ""),
        "location": _s("location"), "source": _s("source"), "url": F.col("url"),
        "resume": relative_path("tailored_resume_docx", project_root),
        "cover_letter": relative_path("cover_letter_docx", project_root),
        "first_seen": F.coalesce(F.when(F.col("_p_first_seen") != "", F.col("_p_first_seen")), F.lit(today)),
        "last_seen": F.lit(today), **{c: _s(f"_p_{c}") for c in USER}}


def _gone(today: str) -> dict:
    """Cells of a previous row whose url is no longer scored: kept whole, with a dated
    note prepended once (then stripped)."""
    note = _s("_p_notes")
    marked = F.regexp_replace(F.concat(F.lit(f"{VANISHED_MARK} as of {today}] "), note), "(?U)^\\s+|\\s+$", "")
    return {**{c: _s(f"_p_{c}") for c in FIELDS}, "notes": F.when(note.startswith(VANISHED_MARK), note).otherwise(marked)}


def _with_url(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("url").isNotNull() & (F.col("url") != ""))


def refresh(scored: DataFrame, tracker: DataFrame, today: str, project_root: str) -> DataFrame:
    """One row per scored posting with a url. Generated columns come from
    the scored table; ``first_seen`` and the user columns are carried from the
    previous tracker row of the same url; ``last_seen`` is today. Adds
    ``is_new`` (no previous row)."""
    j = _with_url(scored).join(_prior(tracker), F.col("url") == F.col("_p_url"), "left")
    return j.select(*[v.alias(c) for c, v in _refreshed(today, project_root).items()], F.col("_had_prior").isNull().alias("is_new"))


def vanished(scored: DataFrame, tracker: DataFrame, today: str) -> DataFrame:
    """Previous tracker rows whose url is no longer in the scored table;
    kept whole, with a dated note prepended once (then stripped)."""
    gone = _prior(tracker).join(_with_url(scored).select("url"), F.col("url") == F.col("_p_url"), "left_anti")
    return gone.select(*[v.alias(c) for c, v in _gone(today).items()], F.lit(False).alias("is_new"))


def build_tracker(scored: DataFrame, tracker: DataFrame, today: str, project_root: str) -> DataFrame:
    """U4, J2 and J3 in one full outer join on the url: a row with a scored posting is
    refreshed (new if it has no previous row), one without has vanished. Either table is
    read, keyed and shuffled once."""
    j = _with_url(scored).join(_prior(tracker), F.col("url") == F.col("_p_url"), "full_outer")
    now, gone = _refreshed(today, project_root), _gone(today)
    scored_now = F.col("url").isNotNull()
    return j.select(*[F.when(scored_now, now[c]).otherwise(gone[c]).alias(c) for c in FIELDS],
                    (scored_now & F.col("_had_prior").isNull()).alias("is_new"))


def score_sort_key():
    """T1 key: integer score (``int()`` semantics; anything else is 0)."""
    s = F.regexp_replace(_s("score"), "(?U)^\\s+|\\s+$", "")
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.cast("long")).otherwise(F.lit(0))


def sort_tracker(rows: DataFrame) -> DataFrame:
    """Score descending, then lower-case company."""
    return rows.orderBy(score_sort_key().desc(), F.lower(_s("company")))


def is_ready() -> Column:
    """P16 as a condition: documents drafted and no submit date."""
    return (_s("resume") != "") & (F.trim(_s("date_submitted")) == "")


def days_waiting(run_date: str) -> Column:
    from lantern.functions.dates import parse_date
    return F.datediff(F.to_date(F.lit(run_date)), parse_date("date_submitted"))


def is_quiet(run_date: str, days: int = 10) -> Column:
    """P17 as a condition: submitted at least ``days`` ago, status blank or 'applied'."""
    return (F.coalesce(days_waiting(run_date) >= days, F.lit(False))
            & F.lower(F.trim(_s("status"))).isin("", "applied"))


def is_vanished() -> Column:
    """P18 as a condition: flagged as no longer listed and not closed."""
    return _s("notes").startswith(VANISHED_MARK) & (F.lower(F.trim(_s("status"))) != "closed")


def ready_rows(rows: DataFrame, exclude_vanished: bool = False) -> DataFrame:
    """Documents drafted and no submit date (report form: not vanished)."""
    cond = is_ready()
    if exclude_vanished:
        cond = cond & ~_s("notes").startswith(VANISHED_MARK)
    return rows.where(cond)


def ready_sorted(rows: DataFrame) -> DataFrame:
    """Ready rows by score descending."""
    return ready_rows(rows).orderBy(score_sort_key().desc())


def gone_quiet(rows: DataFrame, run_date: str, days: int = 10) -> DataFrame:
    """P17 + T3: submitted at least ``days`` ago, status blank or 'applied';
    with days waiting, longest first."""
    return (rows.withColumn("days_waiting", days_waiting(run_date)).where(is_quiet(run_date, days))
            .orderBy(F.desc("days_waiting")))


def vanished_rows(rows: DataFrame) -> DataFrame:
    """Flagged as no longer listed and not closed."""
    return rows.where(is_vanished())


def in_flight(rows: DataFrame) -> DataFrame:
    """Rows with a submit date, with their status ('no status' if blank)."""
    return (rows.where(_s("date_submitted") != "")
            .withColumn("status_label", F.when(_s("status") == "", F.lit("no status"))
                        .otherwise(_s("status"))))


def score_threshold(scored: DataFrame, threshold: int = 6) -> DataFrame:
    """Score at or above the threshold."""
    return scored.where(F.col("score") >= threshold)


def repair_set(scored: DataFrame, threshold: int = 6) -> DataFrame:
    """Above threshold but a resume or a letter is missing."""
    def missing(c):
        return F.col(c).isNull() | (F.col(c) == "")
    return scored.where((F.col("score") >= threshold)
                        & (missing("tailored_resume_docx") | missing("cover_letter_docx")))


def tracker_totals(rows: DataFrame) -> DataFrame:
    """A4: rows, new, with a submit date, applied (parseable date), ready."""
    from lantern.functions.dates import parse_date
    ready = (_s("resume") != "") & (F.trim(_s("date_submitted")) == "")
    agg = [F.count(F.lit(1)).alias("rows"),
           F.count_if(_s("date_submitted") != "").alias("with_submit_date"),
           F.count_if(parse_date("date_submitted").isNotNull()).alias("applied"),
           F.count_if(ready).alias("ready")]
    if "is_new" in rows.columns:
        agg.insert(1, F.count_if(F.col("is_new")).alias("new"))
    return rows.agg(*agg)


def upsert_scored(history: DataFrame, new: DataFrame, keys=("posting_id",),
                  order=("batch_seq",)) -> DataFrame:
    """K1: merge by ``keys`` (default posting_id alone), new wins, all history
    kept (the largest ``order`` columns of a key). Union + ``max_by`` per
    key: one shuffle, skew-safe."""
    both = history.unionByName(new, allowMissingColumns=True)
    return (both.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in both.columns]), F.struct(*order)).alias("_r"))
            .select("_r.*"))


def write_tracker(rows: DataFrame, path: str) -> None:
    """K2: the tracker as CSV with a header, columns in the fixed order, into
    a new version directory (readers switch to it once it is complete). The
    last column, ``row_seq``, is the rows' order: theirs if they have one, else
    that of the sorted rows; several files are not read back in file order."""
    seq = F.col("row_seq") if "row_seq" in rows.columns else F.monotonically_increasing_id()
    (rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in FIELDS], seq.alias("row_seq"))
     .write.mode("error").option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_tracker(spark, path: str) -> DataFrame:
    """R22 reader: the tracker CSV back (multi-line cells allowed), every
    cell text, with the order stored in ``row_seq``."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .schema(", ".join(f"`{c}` string" for c in FIELDS) + ", row_seq long").csv(path))
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in FIELDS], "row_seq")
