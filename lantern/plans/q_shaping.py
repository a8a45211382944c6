"""Resume shaping queries over the ``resume_bullets`` / ``resume_summary``
adapters (W7, W8, W9, W10, M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.functions.predicates import word_count
from lantern.operators import shape as S
from lantern.plans.q_profile import SQL_S22, skill_lines
from lantern.plans.q_text import sql_safe
from lantern.plans.q_watch import SQL_T6, experience_ranks
from lantern.plans.registry import register
from lantern.plans.tables import adapter


def _bullets(spark, sf):
    return S.role_positions(adapter(spark, sf, "resume_bullets"), "role_date")


def _summary(spark, sf):
    return adapter(spark, sf, "resume_summary").withColumn("summary", S.summary_trim(F.col("summary")))


SQL_ROLES = """(SELECT b.*, r.role_pos FROM {resume_bullets} b JOIN (
  SELECT resume_id, role_key, row_number() OVER (PARTITION BY resume_id ORDER BY role_date DESC, role_key) - 1
         AS role_pos
  FROM (SELECT DISTINCT resume_id, role_key, role_date FROM {resume_bullets})) r
  ON r.resume_id = b.resume_id AND r.role_key = b.role_key)"""
_CAP = ("CASE role_pos " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(S.BULLETS_BY_POSITION))
        + f" ELSE {S.BULLETS_TAIL} END")
SQL_CAPPED = f"(SELECT * FROM {SQL_ROLES} WHERE bullet_idx < {_CAP})"


def _wc(x):
    return f"len(list_filter(string_split_regex(coalesce({x}, ''), '\\s+'), lambda w: w <> ''))"


SQL_TRIM = f"""(SELECT resume_id, CASE WHEN len(words) > 80 THEN array_to_string(sents[1:k], ' ') ELSE summary END
       AS summary FROM (
  SELECT *, greatest(1, len(list_filter(
           list_transform(cnts, lambda c, i: list_sum(cnts[1:i])), lambda c: c <= 80))) AS k
  FROM (SELECT *, list_transform(sents, lambda s: {_wc('s')}) AS cnts FROM (
    SELECT *, string_split(regexp_replace(array_to_string(words, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'),
                           chr(1)) AS sents
    FROM (SELECT resume_id, coalesce(summary, '') AS summary,
                 list_filter(string_split_regex(coalesce(summary, ''), '\\s+'), lambda w: w <> '') AS words
          FROM {{resume_summary}})))))"""

SQL_BUDGET = f"""
WITH b AS (SELECT *, {_wc('text')} AS w FROM {SQL_CAPPED}),
tot AS (SELECT coalesce(x.resume_id, s.resume_id) AS resume_id,
               coalesce(x.bw, 0) + coalesce(s.sw, 0) AS total
        FROM (SELECT resume_id, sum(w) AS bw FROM b GROUP BY resume_id) x
        FULL JOIN (SELECT resume_id, {_wc('summary')} AS sw FROM {SQL_TRIM}) s ON s.resume_id = x.resume_id),
r AS (SELECT b.*, t.total,
        sum(CASE WHEN bullet_idx > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY b.resume_id
            ORDER BY role_pos DESC, bullet_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rnk,
        coalesce(sum(CASE WHEN bullet_idx > 0 THEN w ELSE 0 END) OVER (PARTITION BY b.resume_id
            ORDER BY role_pos DESC, bullet_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM b JOIN tot t ON t.resume_id = b.resume_id)
SELECT resume_id, role_pos, bullet_idx FROM r
WHERE NOT (bullet_idx > 0 AND total - bef > 900)
"""


@register("W7_bullet_cap", oracle=f"SELECT resume_id, role_pos, bullet_idx FROM {SQL_CAPPED}")
def w7(spark, sf):
    return S.cap_bullets(_bullets(spark, sf)).select("resume_id", "role_pos", "bullet_idx")


@register("W9_summary_trim", oracle=f"SELECT resume_id, summary FROM {SQL_TRIM}")
def w9(spark, sf):
    return _summary(spark, sf).select("resume_id", "summary")


@register("W8_word_budget", oracle=SQL_BUDGET)
def w8(spark, sf):
    capped = S.cap_bullets(_bullets(spark, sf))
    other = _summary(spark, sf).select("resume_id", word_count(F.col("summary")).alias("words"))
    return S.word_budget(capped, other).select("resume_id", "role_pos", "bullet_idx")


# M7 over the same resumes: employers ranked by the profile (T6), skills and certificates
# (as education) of the inventory with the resume's number, if there is one.
SQL_M7 = f"""
WITH ranks AS (SELECT profile_id AS resume_id, entry_id AS role_key, rank FROM ({SQL_T6})),
sk AS (SELECT inventory AS resume_id, skills FROM ({SQL_S22})),
ed AS (SELECT inventory AS resume_id, sum({_wc('cert')}) AS ew FROM {{profile_certs}} GROUP BY inventory),
rest AS (SELECT s.resume_id, s.summary, coalesce(array_to_string(sk.skills, ' | '), '') AS skills,
                {_wc('s.summary')} + {_wc("array_to_string(sk.skills, ' ')")} + coalesce(ed.ew, 0) AS words
         FROM {SQL_TRIM} s LEFT JOIN sk ON sk.resume_id = s.resume_id LEFT JOIN ed ON ed.resume_id = s.resume_id),
placed AS (SELECT b.*, dense_rank() OVER (PARTITION BY b.resume_id ORDER BY r.rank ASC NULLS LAST, role_date DESC, b.role_key) - 1 AS role_pos
           FROM {{resume_bullets}} b LEFT JOIN ranks r ON r.resume_id = b.resume_id AND r.role_key = b.role_key),
b AS (SELECT *, {_wc('text')} AS w FROM placed WHERE bullet_idx < {_CAP}),
r AS (SELECT b.*, sum(w) OVER (PARTITION BY b.resume_id) + coalesce(rest.words, 0) AS total,
        coalesce(sum(CASE WHEN bullet_idx > 0 THEN w ELSE 0 END) OVER (PARTITION BY b.resume_id
            ORDER BY role_pos DESC, bullet_idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
      FROM b LEFT JOIN rest ON rest.resume_id = b.resume_id),
k AS (SELECT resume_id, string_agg(text, chr(10) ORDER BY role_pos, bullet_idx, text) AS bullets, count(*) AS n
      FROM r WHERE NOT (bullet_idx > 0 AND total - bef > {S.MAX_RESUME_WORDS}) GROUP BY resume_id)
SELECT rest.resume_id, rest.summary, rest.skills, coalesce(k.bullets, '') AS bullets, coalesce(k.n, 0) AS n_bullets
FROM rest LEFT JOIN k ON k.resume_id = rest.resume_id"""


@register("M7_shape_resume", oracle=SQL_M7)
def m7(spark, sf):
    ranks = experience_ranks(spark, sf).select(
        F.col("profile_id").alias("resume_id"), F.col("entry_id").alias("role_key"), "rank")
    skills = skill_lines(spark, sf).withColumnRenamed("inventory", "resume_id")
    certs = adapter(spark, sf, "profile_certs").select(F.col("inventory").alias("resume_id"), F.col("cert").alias("text"))
    return S.shape_resumes(adapter(spark, sf, "resume_bullets"), ranks, adapter(spark, sf, "resume_summary"), skills, certs)


@register("W10_unique_name", oracle=f"""
SELECT ingest_seq, CASE WHEN n = 1 THEN base ELSE base || '-' || CAST(n AS VARCHAR) END AS name FROM (
  SELECT ingest_seq, base, row_number() OVER (PARTITION BY base ORDER BY ingest_seq) AS n FROM (
    SELECT ingest_seq, {sql_safe('company')} || '_' || {sql_safe('title')} || '_2024-01-24' AS base
    FROM {{postings}}))""")
def w10(spark, sf):
    p = adapter(spark, sf, "postings").select("ingest_seq", "company", "title")
    return S.unique_names(p, S.document_base("company", "title", "2024-01-24"), slice_rows=500).select("ingest_seq", "name")


@register("P22_thin_roles", oracle="""
SELECT resume_id, role_key, count(*) AS highlights FROM {resume_bullets}
GROUP BY resume_id, role_key HAVING count(*) < 2""")
def p22(spark, sf):
    return S.thin_roles(adapter(spark, sf, "resume_bullets"))


@register("A3_skill_counts", oracle="""
SELECT inventory, count_if(lower(trim(coalesce(have_it, ''))) = 'yes') AS claimed,
       count(*) - count_if(lower(trim(coalesce(have_it, ''))) = 'yes') AS gaps,
       CASE WHEN count_if(lower(trim(coalesce(have_it, ''))) = 'yes') > 0 THEN 'OK' ELSE 'FAIL' END AS level
FROM {skills} GROUP BY inventory""")
def a3(spark, sf):
    return S.skill_counts(adapter(spark, sf, "skills"))


@register("J7_keep_prefix", oracle="""
WITH h AS (SELECT CAST(role_key AS VARCHAR) AS company, bullet_idx AS pos, text FROM {resume_bullets}),
k AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS company, 'Delivered ' || p AS prefix
      FROM {orders}, (SELECT unnest(['small', 'red', 'hot']) AS p) WHERE o_orderstatus = 'F'),
hit AS (SELECT DISTINCT h.company, h.pos FROM h JOIN k ON k.company = h.company AND starts_with(h.text, k.prefix))
SELECT h.company, h.pos FROM h JOIN hit ON hit.company = h.company AND hit.pos = h.pos
UNION ALL
SELECT h.company, h.pos FROM h WHERE h.company NOT IN (SELECT company FROM hit) AND h.pos < 4""")
def j7(spark, sf):
    """Highlights are each order's line-item bullets; finished orders keep
    those starting with 'Delivered small', 'Delivered red' or 'Delivered hot'."""
    from lantern.plans.tables import read_table
    b = adapter(spark, sf, "resume_bullets").select(F.col("role_key").cast("string").alias("company"),
                                                    F.col("bullet_idx").alias("pos"), "text")
    o = read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
    keep = o.select(F.col("o_orderkey").cast("string").alias("company"),
                    F.explode(F.array(*[F.lit(f"Delivered {w}") for w in ("small", "red", "hot")])).alias("prefix"))
    return S.keep_prefix(b, keep).select("company", "pos")
