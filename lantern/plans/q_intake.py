"""Intake queries: filters, dedupe, routing, drop log and reports (P1-P9, D1, D2,
J1, A1, A2, U1, U2) over the ``postings`` adapter."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators import dedupe, filters, reports
from lantern.plans.registry import q, register, sql_any, sql_first
from lantern.plans.settings import BLOCKED_COMPANIES, EXCLUDES, KEYWORDS, LOCATIONS, RUN_DATE
from lantern.plans.tables import adapter

KW, EX, LOC = KEYWORDS, EXCLUDES, LOCATIONS
_T = "lower(coalesce(title, ''))"
_L = "lower(coalesce(location, ''))"
_STATE = filters.STATE_ABBREV


def _sql_location() -> str:
    parts = [f"contains({_L}, 'remote')"]
    for w in LOC:
        w = w.lower()
        parts.append(f"contains({_L}, {q(w)})")
        if w in _STATE:
            parts.append(f"regexp_matches({_L}, {q(chr(92) + 'b' + _STATE[w] + chr(92) + 'b')})")
        if len(w) <= 3:
            parts.append(f"regexp_matches({_L}, {q(chr(92) + 'b' + w + chr(92) + 'b')})")
    return "(" + " OR ".join(parts) + ")"


SQL_P1 = sql_any(_T, KW)
SQL_P2 = sql_any(_T, EX)
SQL_P3 = _sql_location()
SQL_P4 = f"({SQL_P1} AND NOT {SQL_P2} AND {SQL_P3})"
SQL_P4_NOLOC = f"({SQL_P1} AND NOT {SQL_P2})"
SQL_P4_NOEX = f"({SQL_P1} AND {SQL_P3})"
SQL_LINKEDIN = (f"({SQL_P4_NOLOC} AND (contains({_T}, 'remote') OR {SQL_P3} OR "
                f"{sql_any(_L, list(filters.NATIONWIDE))}))")
SQL_P5 = (f"(CASE WHEN source = 'email' THEN {SQL_P4_NOLOC} "
          f"WHEN source = 'linkedin' THEN {SQL_LINKEDIN} ELSE {SQL_P4} END)")
SQL_P6 = ("NOT (" + " OR ".join(
    f"contains(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]', '', 'g'), "
    f"{q(''.join(c for c in b.lower() if c.isascii() and c.isalnum()))})" for b in BLOCKED_COMPANIES) + ")")
SQL_P7 = (f"CASE WHEN {sql_first(_T, EX)} IS NOT NULL THEN 'title excluded: ' || {sql_first(_T, EX)} "
          f"WHEN NOT {SQL_P1} THEN 'no title term matched' ELSE 'location' END")

# D1 over the company-blocked postings, in SQL (window form).
SQL_D1 = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY source, company, posting_id ORDER BY ingest_seq) AS rn
  FROM {{postings}} WHERE {SQL_P6}) WHERE rn = 1
"""
SQL_ROUTED = f"SELECT * FROM ({SQL_D1}) WHERE {SQL_P5}"
SQL_D2 = f"""
SELECT * FROM ({SQL_ROUTED}) WHERE source NOT IN ('linkedin', 'indeed')
UNION ALL
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY source, lower(regexp_replace(coalesce(company, ''), '^\\s+|\\s+$', '', 'g')),
                                            lower(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g')) ORDER BY ingest_seq) AS rn
  FROM ({SQL_ROUTED}) WHERE source IN ('linkedin', 'indeed')) WHERE rn = 1
"""
SQL_DROPPED = f"""
SELECT {q(RUN_DATE)} AS date, source, {SQL_P7} AS reason, coalesce(title, '') AS title,
       coalesce(company, '') AS company, coalesce(location, '') AS location,
       coalesce(url, '') AS url, ingest_seq
FROM ({SQL_D1}) WHERE source IN ('linkedin', 'indeed') AND NOT {SQL_P5}
"""


def _postings(spark, sf):
    return adapter(spark, sf, "postings")


def _deduped(spark, sf):
    return dedupe.dedupe_posting_key(filters.company_block(_postings(spark, sf), BLOCKED_COMPANIES))


@register("P1_title_match", oracle=f"SELECT ingest_seq, title FROM {{postings}} WHERE {SQL_P1}")
def p1(spark, sf):
    return _postings(spark, sf).where(filters.title_match(KW)).select("ingest_seq", "title")


@register("P2_title_exclude", oracle=f"SELECT ingest_seq, title FROM {{postings}} WHERE {SQL_P2}")
def p2(spark, sf):
    return _postings(spark, sf).where(filters.title_excluded(EX)).select("ingest_seq", "title")


@register("P3_location_match", oracle=f"SELECT ingest_seq, location FROM {{postings}} WHERE {SQL_P3}")
def p3(spark, sf):
    return _postings(spark, sf).where(filters.location_match(LOC)).select("ingest_seq", "location")


@register("P4_keyword_filter", oracle=f"SELECT ingest_seq, title, location FROM {{postings}} WHERE {SQL_P4}")
def p4(spark, sf):
    return filters.keyword_filter(_postings(spark, sf), KW, LOC, EX).select("ingest_seq", "title", "location")


@register("P5_source_routing", oracle=f"SELECT ingest_seq, source FROM {{postings}} WHERE {SQL_P5}")
def p5(spark, sf):
    return _postings(spark, sf).where(filters.routed_rule(KW, LOC, EX)).select("ingest_seq", "source")


@register("P6_company_block", oracle=f"SELECT ingest_seq, company FROM {{postings}} WHERE {SQL_P6}")
def p6(spark, sf):
    return filters.company_block(_postings(spark, sf), BLOCKED_COMPANIES).select("ingest_seq", "company")


@register("P7_drop_reason", oracle=f"SELECT ingest_seq, {SQL_P7} AS reason FROM {{postings}}")
def p7(spark, sf):
    return _postings(spark, sf).select("ingest_seq", filters.drop_reason(KW, EX).alias("reason"))


@register("P8_dropped_rows", oracle=SQL_DROPPED)
def p8(spark, sf):
    return filters.dropped_rows(_deduped(spark, sf), KW, LOC, EX, RUN_DATE)


@register("P9_exclusion_impact", oracle=f"""
SELECT count_if({SQL_P4_NOEX}) AS kept_without_exclusions,
       count_if({SQL_P4}) AS kept_with_exclusions,
       count_if({SQL_P4_NOEX}) - count_if({SQL_P4}) AS removed_by_exclusions
FROM {{postings}} WHERE source NOT IN ('email', 'linkedin', 'indeed')""")
def p9(spark, sf):
    others = _postings(spark, sf).where(~F.col("source").isin("email", "linkedin", "indeed"))
    return filters.exclusion_impact(others, KW, LOC, EX)


@register("D1_dedupe_posting_key", oracle=f"SELECT ingest_seq, source, company, posting_id FROM ({SQL_D1})")
def d1(spark, sf):
    return _deduped(spark, sf).select("ingest_seq", "source", "company", "posting_id")


@register("D2_dedupe_role", oracle=f"SELECT ingest_seq, source, title FROM ({SQL_D2})")
def d2(spark, sf):
    routed = _deduped(spark, sf).where(filters.routed_rule(KW, LOC, EX))
    return dedupe.dedupe_role(routed).select("ingest_seq", "source", "title")


@register("U2_union_filtered", oracle=f"SELECT ingest_seq, source, company, title, location, url FROM ({SQL_D2})")
def u2(spark, sf):
    return (dedupe.collect_postings(_postings(spark, sf), KW, LOC, EX, BLOCKED_COMPANIES)
            .select("ingest_seq", "source", "company", "title", "location", "url"))


ORACLES_J1 = f"""
SELECT c.ingest_seq, c.source, c.url FROM ({SQL_D2}) c
WHERE NOT EXISTS (SELECT 1 FROM {{scored}} s WHERE s.url = c.url)"""


@register("J1_seen_anti", oracle=ORACLES_J1)
def j1(spark, sf):
    from lantern.operators.tracker import unseen
    survivors = dedupe.collect_postings(_postings(spark, sf), KW, LOC, EX, BLOCKED_COMPANIES)
    return unseen(survivors, adapter(spark, sf, "scored")).select("ingest_seq", "source", "url")


@register("A1_drop_report", oracle=f"""
WITH dropped AS ({SQL_DROPPED}),
counts AS (
  SELECT source, count(*) AS n_dropped,
         count_if(reason = 'no title term matched') AS n_no_term,
         count_if(starts_with(reason, 'title excluded')) AS n_excluded
  FROM dropped GROUP BY source),
titles AS (
  SELECT source, lower(st) AS lt, arg_min(st, ingest_seq) AS t, min(ingest_seq) AS first_seq
  FROM (SELECT *, regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS st FROM dropped)
  WHERE reason = 'no title term matched' AND st <> ''
  GROUP BY source, lower(st)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first_seq) AS rn FROM titles),
firsts AS (SELECT source, string_agg(substr(t, 1, 72), ' | ' ORDER BY rn) AS unmatched_titles
           FROM ranked WHERE rn <= 6 GROUP BY source),
nt AS (SELECT source, count(*) AS n_titles FROM titles GROUP BY source)
SELECT c.source, c.n_dropped, c.n_no_term, c.n_excluded,
       c.n_dropped - c.n_no_term - c.n_excluded AS n_location,
       coalesce(f.unmatched_titles, '') AS unmatched_titles,
       CAST(greatest(coalesce(nt.n_titles, 0) - 6, 0) AS BIGINT) AS more_titles
FROM counts c LEFT JOIN nt USING (source) LEFT JOIN firsts f USING (source)""")
def a1(spark, sf):
    dropped = filters.dropped_rows(_deduped(spark, sf), KW, LOC, EX, RUN_DATE)
    return reports.drop_report(dropped)


@register("A2_source_counts", oracle=f"""
SELECT c.source, count(*) AS postings, count_if(s.url IS NULL) AS never_scored
FROM ({SQL_D2}) c LEFT JOIN (SELECT DISTINCT url FROM {{scored}}) s ON s.url = c.url
GROUP BY c.source""")
def a2(spark, sf):
    survivors = dedupe.narrow_survivors(_postings(spark, sf), KW, LOC, EX, BLOCKED_COMPANIES)
    return reports.source_counts(survivors, adapter(spark, sf, "scored"))


def flagship(spark, sf):
    """The minimum slice: P6 -> D1 -> P5 -> D2 -> J1 -> A2."""
    return a2(spark, sf)


# Last nights' log: every dropped row once more, dated back by its text length
# (some beyond the 60-day window).
SQL_OLD_LOG = f"""
SELECT CAST(CAST(DATE '{RUN_DATE}' - CAST(length(title) + ingest_seq % 40 AS INT) AS DATE) AS STRING) AS date,
       source, reason, title, company, location, url FROM ({SQL_DROPPED})"""


@register("K3_dropped_log_sink", oracle=f"""
SELECT * FROM ({SQL_OLD_LOG}) WHERE date >= CAST(DATE '{RUN_DATE}' - INTERVAL 60 DAY AS DATE)::VARCHAR
UNION ALL SELECT date, source, reason, title, company, location, url FROM ({SQL_DROPPED})""")
def k3(spark, sf):
    new = filters.dropped_rows(_deduped(spark, sf), KW, LOC, EX, RUN_DATE)
    old = new.select(F.date_format(F.date_sub(F.to_date(F.lit(RUN_DATE)),
                                              (F.length("title") + F.col("ingest_seq") % 40).cast("int")),
                                   "yyyy-MM-dd").alias("date"),
                     "source", "reason", "title", "company", "location", "url")
    return filters.dropped_log(old, new, RUN_DATE)


@register("U5_log_union", oracle=f"""
SELECT * FROM ({SQL_OLD_LOG}) WHERE date >= CAST(DATE '{RUN_DATE}' - INTERVAL 60 DAY AS DATE)::VARCHAR
UNION ALL SELECT date, source, reason, title, company, location, url FROM ({SQL_DROPPED})""")
def u5(spark, sf):
    """The pruned old log and tonight's drops, appended (the union K3 writes)."""
    return k3(spark, sf)
