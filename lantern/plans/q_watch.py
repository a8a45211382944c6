"""Watchlist (J5) and canonical employer (J6, T6) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators import watch as Wt
from lantern.plans.registry import q, register
from lantern.plans.tables import adapter

# Run setting: the watched companies.
WATCH = ["Eauouon Inc", "The Retitioning Company", "Attion", "Laleen Corporation", "Th", "Nteres-Atre"]


def _watch_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS watch_idx, {q(c)} AS watched, {q(Wt.watch_short(c))} AS short"
                              for i, c in enumerate(WATCH))
    return f"({rows})"


@register("J5_watchlist_prefix", oracle=f"""
WITH f AS (SELECT url AS key, row_seq AS seq, company, title,
                  regexp_replace(lower(coalesce(company, '')), '[^a-z0-9]', '', 'g') AS fc
           FROM {{applications}}),
m AS (SELECT f.*, w.watch_idx, w.watched FROM f JOIN {_watch_sql()} w
      ON f.fc <> '' AND (starts_with(f.fc, w.short) OR starts_with(w.short, f.fc)))
SELECT key, arg_min(seq, (watch_idx, seq)) AS seq, arg_min(company, (watch_idx, seq)) AS company,
       arg_min(title, (watch_idx, seq)) AS title, arg_min(watched, (watch_idx, seq)) AS watched
FROM m GROUP BY key""")
def j5(spark, sf):
    apps = adapter(spark, sf, "applications").select(F.col("url").alias("key"), F.col("row_seq").alias("seq"),
                                                     "company", "title")
    return Wt.watchlist_matches(apps, Wt.watch_table(spark, WATCH))


SQL_J6 = """
SELECT e.profile_id, e.entry_id, e.company, m.canon_idx, c.company AS canon_company
FROM {resume_entries} e
LEFT JOIN (
  SELECT e.profile_id, e.entry_id, min(c.idx) AS canon_idx
  FROM {resume_entries} e JOIN {canonical} c ON c.profile_id = e.profile_id
   AND (contains(lower(e.company), lower(c.company))
        OR contains(lower(c.company), regexp_replace(split_part(lower(e.company), '(', 1), '^\\s+|\\s+$', '', 'g')))
  GROUP BY e.profile_id, e.entry_id) m ON m.profile_id = e.profile_id AND m.entry_id = e.entry_id
LEFT JOIN {canonical} c ON c.profile_id = m.profile_id AND c.idx = m.canon_idx
"""


@register("J6_canonical_employer", oracle=SQL_J6)
def j6(spark, sf):
    return Wt.canonical_match(adapter(spark, sf, "resume_entries"), adapter(spark, sf, "canonical")) \
        .select("profile_id", "entry_id", "company", "canon_idx", "canon_company")


SQL_T6 = f"""
SELECT j.profile_id, j.entry_id, coalesce(j.canon_company, j.company) AS company,
       coalesce(j.canon_idx, n.n, 0) AS rank
FROM ({SQL_J6}) j LEFT JOIN (SELECT profile_id, count(*) AS n FROM {{canonical}} GROUP BY profile_id) n
  ON n.profile_id = j.profile_id"""


def experience_ranks(spark, sf):
    canon = adapter(spark, sf, "canonical")
    m = Wt.canonical_match(adapter(spark, sf, "resume_entries"), canon)
    n = canon.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n"))
    return Wt.experience_order(m, n).select("profile_id", "entry_id", "company",
                                            F.col("rank").cast("long").alias("rank"))


@register("T6_experience_order", oracle=SQL_T6)
def t6(spark, sf):
    return experience_ranks(spark, sf)
