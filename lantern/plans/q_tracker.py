"""Tracker queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lantern.functions.dates import parse_date
from lantern.operators import tracker as T
from lantern.plans.registry import register
from lantern.plans.settings import RUN_DATE
from lantern.session import checkpoint_dir
from lantern.plans.tables import adapter

ROOT = "/home/user/jobs"
TODAY = RUN_DATE

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return _STRIP.format(x=x)


# --- S6 in SQL: the same shapes, validated through try_cast ------------------
_M = "(1[0-2]|0[1-9]|[1-9])"
_D = "(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])"


def _iso(y, m, d):
    return (f"TRY_CAST(lpad({y}, 4, '0') || '-' || lpad(trim({m}), 2, '0') || '-' || "
            f"lpad(trim({d}), 2, '0') AS DATE)")


def sql_parse_date(x: str, brief: bool = True) -> str:
    s = strip(f"coalesce({x}, '')")
    rx_ymd = f"^([0-9]{{{{4}}}})-{_M}-{_D}$"
    rx_mdY = f"^{_M}/{_D}/([0-9]{{{{4}}}})$"
    rx_mdy = f"^{_M}/{_D}/([0-9]{{{{2}}}})$"
    rx_dmY = f"^{_D}/{_M}/([0-9]{{{{4}}}})$"

    def g(rx, i):
        return f"regexp_extract({s}, '{rx}', {i})"
    yy = f"CAST({g(rx_mdy, 3)} AS INT)"
    parts = [
        f"CASE WHEN regexp_matches({s}, '{rx_ymd}') THEN {_iso(g(rx_ymd, 1), g(rx_ymd, 2), g(rx_ymd, 3))} END",
        f"CASE WHEN regexp_matches({s}, '{rx_mdY}') THEN {_iso(g(rx_mdY, 3), g(rx_mdY, 1), g(rx_mdY, 2))} END",
        f"CASE WHEN regexp_matches({s}, '{rx_mdy}') THEN "
        f"{_iso(f'CAST(CASE WHEN {yy} < 69 THEN {yy} + 2000 ELSE {yy} + 1900 END AS STRING)', g(rx_mdy, 1), g(rx_mdy, 2))} END",
    ]
    if brief:
        parts.append(f"CASE WHEN regexp_matches({s}, '{rx_dmY}') THEN "
                     f"{_iso(g(rx_dmY, 3), g(rx_dmY, 2), g(rx_dmY, 1))} END")
    return f"(CASE WHEN {s} = '' OR upper({s}) = 'NA' THEN NULL ELSE COALESCE({', '.join(parts)}) END)"


PRIOR = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_seq DESC) AS rn
           FROM {tracker_old} WHERE url IS NOT NULL AND url <> '') WHERE rn = 1)"""


def _rel(x):
    return (f"CASE WHEN coalesce({x}, '') = '' THEN '' "
            f"WHEN starts_with({x}, '{ROOT}/') THEN substr({x}, {len(ROOT) + 2}) "
            f"ELSE regexp_extract({x}, '[^/]*$', 0) END")


SQL_SALARY = ("CASE WHEN s.salary_high IS NOT NULL AND s.salary_high <> 0 THEN "
              "'$' || CAST(CAST(floor(s.salary_low / 1000) AS BIGINT) AS STRING) || 'K-$' || "
              "CAST(CAST(floor(s.salary_high / 1000) AS BIGINT) AS STRING) || 'K' ELSE '' END")

SQL_REFRESH = f"""
SELECT coalesce(CAST(s.score AS STRING), '') AS score,
       CASE WHEN coalesce(s.overqualification_risk, false) THEN 'yes' ELSE '' END AS overqualified,
       {SQL_SALARY} AS salary,
       coalesce(s.company, '') AS company, {strip("coalesce(s.title, '')")} AS title,
       coalesce(s.location, '') AS location, coalesce(s.source, '') AS source, s.url,
       {_rel('s.tailored_resume_docx')} AS resume, {_rel('s.cover_letter_docx')} AS cover_letter,
       coalesce(CASE WHEN p.first_seen <> '' THEN p.first_seen END, '{TODAY}') AS first_seen,
       '{TODAY}' AS last_seen,
       coalesce(p.status, '') AS status, coalesce(p.date_submitted, '') AS date_submitted,
       coalesce(p.follow_up, '') AS follow_up, coalesce(p.contact, '') AS contact,
       coalesce(p.notes, '') AS notes, p.url IS NULL AS is_new
FROM {{scored}} s LEFT JOIN {PRIOR} p ON p.url = s.url
WHERE s.url IS NOT NULL AND s.url <> ''
"""

SQL_VANISHED = f"""
SELECT coalesce(score, '') AS score, coalesce(overqualified, '') AS overqualified,
       coalesce(salary, '') AS salary, coalesce(company, '') AS company, coalesce(title, '') AS title,
       coalesce(location, '') AS location, coalesce(source, '') AS source, url,
       coalesce(resume, '') AS resume, coalesce(cover_letter, '') AS cover_letter,
       coalesce(first_seen, '') AS first_seen, coalesce(last_seen, '') AS last_seen,
       coalesce(status, '') AS status, coalesce(date_submitted, '') AS date_submitted,
       coalesce(follow_up, '') AS follow_up, coalesce(contact, '') AS contact,
       CASE WHEN starts_with(coalesce(notes, ''), '[no longer listed') THEN coalesce(notes, '')
            ELSE {strip("'[no longer listed as of " + TODAY + "] ' || coalesce(notes, '')")} END AS notes,
       false AS is_new
FROM {PRIOR} p WHERE NOT EXISTS (SELECT 1 FROM {{scored}} s WHERE s.url = p.url)
"""
SQL_TRACKER = f"({SQL_REFRESH} UNION ALL {SQL_VANISHED})"
SQL_SCORE_KEY = (f"CASE WHEN regexp_matches({strip('score')}, '^[+-]?[0-9]+$') "
                 f"THEN CAST({strip('score')} AS BIGINT) ELSE 0 END")
SQL_READY = "resume <> '' AND trim(date_submitted) = ''"
SQL_DATE = sql_parse_date("date_submitted")


def _tracker(spark, sf):
    return T.build_tracker(adapter(spark, sf, "scored"), adapter(spark, sf, "tracker_old"), TODAY, ROOT)


@register("R22_tracker_scan", oracle=f"SELECT url, row_seq, status, notes FROM {PRIOR}")
def r22(spark, sf):
    """The old tracker lands as CSV and is read back before it is keyed."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tracker-{uuid.uuid4().hex}"
    T.write_tracker(adapter(spark, sf, "tracker_old"), path)
    return T.latest_by_url(T.read_tracker(spark, path)).select("url", "row_seq", "status", "notes")


@register("J2_tracker_refresh", oracle=SQL_REFRESH)
def j2(spark, sf):
    return T.refresh(adapter(spark, sf, "scored"), adapter(spark, sf, "tracker_old"), TODAY, ROOT)


@register("J3_vanished", oracle=SQL_VANISHED)
def j3(spark, sf):
    return T.vanished(adapter(spark, sf, "scored"), adapter(spark, sf, "tracker_old"), TODAY)


@register("U4_tracker_union", oracle=f"SELECT * FROM {SQL_TRACKER}")
def u4(spark, sf):
    return _tracker(spark, sf)


@register("T1_tracker_sort", oracle=f"""
SELECT url, score, {SQL_SCORE_KEY} AS score_key, lower(company) AS company_key FROM {SQL_TRACKER}
ORDER BY score_key DESC, company_key""")
def t1(spark, sf):
    rows = T.sort_tracker(_tracker(spark, sf))
    return rows.select("url", "score", T.score_sort_key().alias("score_key"),
                       F.lower("company").alias("company_key"))


@register("P16_ready_rows", oracle=f"SELECT url, score, resume FROM {SQL_TRACKER} WHERE {SQL_READY}")
def p16(spark, sf):
    return T.ready_rows(_tracker(spark, sf)).select("url", "score", "resume")


@register("T2_ready_sort", oracle=f"""
SELECT url, {SQL_SCORE_KEY} AS score_key FROM {SQL_TRACKER}
WHERE {SQL_READY} AND NOT starts_with(notes, '[no longer listed') ORDER BY score_key DESC""")
def t2(spark, sf):
    rows = T.ready_rows(_tracker(spark, sf), exclude_vanished=True)
    return rows.select("url", T.score_sort_key().alias("score_key")).orderBy(F.desc("score_key"))


@register("P17_gone_quiet", oracle=f"""
SELECT url, status, date_submitted, CAST(date_diff('day', {SQL_DATE}, DATE '{TODAY}') AS INT) AS days_waiting
FROM {SQL_TRACKER}
WHERE {SQL_DATE} IS NOT NULL AND lower(trim(status)) IN ('', 'applied')
  AND date_diff('day', {SQL_DATE}, DATE '{TODAY}') >= 10""")
def p17(spark, sf):
    return T.gone_quiet(_tracker(spark, sf), TODAY).select("url", "status", "date_submitted", "days_waiting")


@register("T3_quiet_sort", oracle=f"""
SELECT url, CAST(date_diff('day', {SQL_DATE}, DATE '{TODAY}') AS INT) AS days_waiting FROM {SQL_TRACKER}
WHERE {SQL_DATE} IS NOT NULL AND lower(trim(status)) IN ('', 'applied')
  AND date_diff('day', {SQL_DATE}, DATE '{TODAY}') >= 10 ORDER BY days_waiting DESC""")
def t3(spark, sf):
    return T.gone_quiet(_tracker(spark, sf), TODAY).select("url", "days_waiting")


@register("P18_vanished_rows", oracle=f"""
SELECT url, status, notes FROM {SQL_TRACKER}
WHERE starts_with(notes, '[no longer listed') AND lower(trim(status)) <> 'closed'""")
def p18(spark, sf):
    return T.vanished_rows(_tracker(spark, sf)).select("url", "status", "notes")


@register("P27_in_flight", oracle=f"""
SELECT url, date_submitted, CASE WHEN status = '' THEN 'no status' ELSE status END AS status_label
FROM {SQL_TRACKER} WHERE date_submitted <> ''""")
def p27(spark, sf):
    return T.in_flight(_tracker(spark, sf)).select("url", "date_submitted", "status_label")


@register("A4_tracker_totals", oracle=f"""
SELECT count(*) AS rows, count_if(is_new) AS new, count_if(date_submitted <> '') AS with_submit_date,
       count_if({SQL_DATE} IS NOT NULL) AS applied, count_if({SQL_READY}) AS ready
FROM {SQL_TRACKER}""")
def a4(spark, sf):
    return T.tracker_totals(_tracker(spark, sf))


@register("S6_parse_date", oracle=f"""
SELECT row_seq, date_submitted, {SQL_DATE} AS parsed,
       {sql_parse_date('date_submitted', brief=False)} AS parsed_replies
FROM {{tracker_old}}""")
def s6(spark, sf):
    from lantern.functions.dates import FORMATS_REPLIES
    return adapter(spark, sf, "tracker_old").select(
        "row_seq", "date_submitted", parse_date("date_submitted").alias("parsed"),
        parse_date("date_submitted", FORMATS_REPLIES).alias("parsed_replies"))


@register("S12_salary_label", oracle=f"SELECT s.url, {SQL_SALARY} AS salary FROM {{scored}} s")
def s12(spark, sf):
    return adapter(spark, sf, "scored").select("url", T.salary_label().alias("salary"))


@register("S31_relative_path", oracle=f"""
SELECT url, {_rel('tailored_resume_docx')} AS resume, {_rel('cover_letter_docx')} AS cover_letter
FROM {{scored}}""")
def s31(spark, sf):
    return adapter(spark, sf, "scored").select(
        "url", T.relative_path("tailored_resume_docx", ROOT).alias("resume"),
        T.relative_path("cover_letter_docx", ROOT).alias("cover_letter"))


@register("P14_score_threshold", oracle="SELECT posting_id, url, score FROM {scored} WHERE score >= 6")
def p14(spark, sf):
    return T.score_threshold(adapter(spark, sf, "scored")).select("posting_id", "url", "score")


@register("P15_repair_set", oracle="""
SELECT posting_id, url FROM {scored} WHERE score >= 6
  AND (coalesce(tailored_resume_docx, '') = '' OR coalesce(cover_letter_docx, '') = '')""")
def p15(spark, sf):
    return T.repair_set(adapter(spark, sf, "scored")).select("posting_id", "url")


# K1: last night's stored table is the labelled postings; tonight's batch is
# every posting with a title term. Merge by posting_id alone, new wins.
@register("K1_scored_sink", oracle="""
SELECT posting_id, url, batch_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY posting_id ORDER BY night DESC, batch_seq DESC) AS rn FROM (
    SELECT posting_id, url, ingest_seq AS batch_seq, 0 AS night FROM {scored}
    UNION ALL
    SELECT posting_id, url, ingest_seq AS batch_seq, 1 AS night FROM {postings}
    WHERE contains(lower(coalesce(title, '')), 'tion'))) WHERE rn = 1""")
def k1(spark, sf):
    old = adapter(spark, sf, "scored").select("posting_id", "url", F.col("ingest_seq").alias("batch_seq"), F.lit(0).alias("night"))
    new = (adapter(spark, sf, "postings").where(F.lower(F.coalesce("title", F.lit(""))).contains("tion"))
           .select("posting_id", "url", F.col("ingest_seq").alias("batch_seq"), F.lit(1).alias("night")))
    return T.upsert_scored(old, new, order=("night", "batch_seq")).select("posting_id", "url", "batch_seq")
