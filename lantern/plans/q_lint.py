"""Letter lint queries: each document is a letter whose sentences are bullets;
the benchmark passages form the single profile whose numbers are grounded."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lantern.operators import lint as L
from lantern.plans.registry import q, register
from lantern.plans.tables import read_table


def bullets(spark, sf, docs=None):
    d = read_table(spark, sf, "documents") if docs is None else docs
    return d.select(F.col("doc_id").alias("letter_id"), F.lit(1).alias("profile_id"),
                    F.posexplode(F.split("text", "[.!?]\\s+")).alias("pos", "text"))


def profiles(spark, sf):
    b = read_table(spark, sf, "benchmark")
    return b.select(F.lit(1).alias("profile_id"), "text")


def sql_bullets(docs: str = "documents") -> str:
    return f"""(SELECT doc_id AS letter_id, 1 AS profile_id, pos - 1 AS pos, text FROM (
  SELECT doc_id, unnest(string_split_regex(text, '[.!?]\\s+')) AS text,
         generate_subscripts(string_split_regex(text, '[.!?]\\s+'), 1) AS pos FROM {docs}))"""


SQL_BULLETS = sql_bullets()


@register("S17_letter_body", oracle=f"""
SELECT letter_id, string_agg(text, ' ' ORDER BY pos) AS body FROM {SQL_BULLETS}
WHERE coalesce(text, '') <> '' GROUP BY letter_id""")
def s17(spark, sf):
    return L.letter_body(bullets(spark, sf))


def _s18_sql(bullets_sql: str = None) -> str:
    """The tells in RE2: Unicode word characters spelled out, and the one
    look-ahead rule (', not X' unless X is 'only') as a test on the captured
    words."""
    parts = []
    for pat, label in L.AI_TELLS:
        if "(?!" in pat:
            words = "regexp_extract_all(body, '(?i),\\s+not\\s+([\\p{{L}}\\p{{N}}_]+)', 1)"
            cond = f"len(list_filter({words}, lambda w: lower(w) <> 'only')) > 0"
        else:
            # RE2's \\b is ASCII; the tells are English phrases beside spaces
            cond = f"regexp_matches(body, {q('(?i)' + pat)})"
        parts.append(f"CASE WHEN {cond} THEN {q(label)} END")
    return f"""
SELECT letter_id, array_to_string(list_filter([{", ".join(parts)}], lambda x: x IS NOT NULL), ' | ') AS tells
FROM (SELECT letter_id, string_agg(text, ' ' ORDER BY pos) AS body FROM {bullets_sql or SQL_BULLETS}
      WHERE coalesce(text, '') <> '' GROUP BY letter_id)"""


@register("S18_ai_tells", oracle=_s18_sql())
def s18(spark, sf):
    t = L.ai_tells(L.letter_body(bullets(spark, sf)))
    return t.select("letter_id", F.array_join("tells", " | ").alias("tells"))


@register("S20_invented_scope", oracle=f"""
SELECT letter_id, pos, regexp_extract(text, {q(L.INVENTED_SCOPE.replace("(?iU)", "(?i)")).replace("{", "{{").replace("}", "}}")}, 0) AS phrase,
       'invented scope "' || regexp_extract(text, {q(L.INVENTED_SCOPE.replace("(?iU)", "(?i)")).replace("{", "{{").replace("}", "}}")}, 0)
       || '" in: "' || substr(text, 1, 56) || '..."' AS problem
FROM {SQL_BULLETS}
WHERE regexp_matches(coalesce(text, ''), {q(L.INVENTED_SCOPE.replace("(?iU)", "(?i)")).replace("{", "{{").replace("}", "}}")})""")
def s20(spark, sf):
    return L.invented_scope(bullets(spark, sf))


@register("J9_number_grounding", oracle=f"""
WITH b AS {SQL_BULLETS},
n AS (SELECT letter_id, profile_id, pos, text, unnest(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)?', 0)) AS num,
             generate_subscripts(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)?', 0), 1) - 1 AS k FROM b),
p AS (SELECT DISTINCT 1 AS profile_id, unnest(regexp_extract_all(lower(text), '\\d+(?:\\.\\d+)?', 0)) AS num FROM benchmark)
SELECT letter_id, pos, k, num,
       'number "' || num || '" is not in the profile: "' || substr(text, 1, 56) || '..."' AS problem
FROM n WHERE length(num) >= 2 AND NOT EXISTS (SELECT 1 FROM p WHERE p.profile_id = n.profile_id AND p.num = n.num)""")
def j9(spark, sf):
    return L.ungrounded_numbers(bullets(spark, sf), L.profile_numbers(profiles(spark, sf)))


_J9_BODY = """
n AS (SELECT letter_id, profile_id, pos, text, unnest(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)?', 0)) AS num,
             generate_subscripts(regexp_extract_all(coalesce(text, ''), '\\d+(?:\\.\\d+)?', 0), 1) - 1 AS k FROM b),
p AS (SELECT DISTINCT 1 AS profile_id, unnest(regexp_extract_all(lower(text), '\\d+(?:\\.\\d+)?', 0)) AS num FROM benchmark),
nums AS (SELECT letter_id, pos, k + 1 AS k,
                'number "' || num || '" is not in the profile: "' || substr(text, 1, 56) || '..."' AS problem
         FROM n WHERE length(num) >= 2
           AND NOT EXISTS (SELECT 1 FROM p WHERE p.profile_id = n.profile_id AND p.num = n.num))"""


# Run setting: the employers of the profile the letters are checked against.
EMPLOYERS = ["Harbor Foods", "Attion Labs"]


def letters(spark, sf, docs=None):
    """Each document as a grouped letter: a group per line (header = the
    line, bullets = its sentences); documents of one
    line are legacy prose letters."""
    d = read_table(spark, sf, "documents") if docs is None else docs
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    groups = F.transform(lines, lambda ln: F.struct(ln.alias("header"),
                                                    F.split(ln, "[.!?] ").alias("bullets")))
    one = F.size(lines) <= 1
    return d.select(F.col("doc_id").alias("letter_id"),
                    F.when(one, F.array().cast("array<struct<header:string,bullets:array<string>>>"))
                    .otherwise(groups).alias("groups"),
                    F.when(one, lines).otherwise(F.array().cast("array<string>")).alias("paragraphs"),
                    _employers().alias("employers"))


#: The rule in one pattern for DuckDB: figures, methods, employers and their first words.
_SPECIFIC = L.CONCRETE.replace("(?iu)", "(?i)") + "".join(
    "|" + re.escape(n) for e in EMPLOYERS for n in [e, *(w for w in e.split()[:1] if len(w) > 3)])


def _employers():
    return F.array(*[F.lit(e) for e in EMPLOYERS])


@register("S21_specific_pattern", oracle=f"""
SELECT letter_id, pos, regexp_matches(coalesce(text, ''),
       {q(_SPECIFIC).replace("{", "{{").replace("}", "}}")}) AS specific
FROM {SQL_BULLETS}""")
def s21(spark, sf):
    b = bullets(spark, sf)
    return b.select("letter_id", "pos", L.is_specific(F.col("text"), L.employer_names(_employers())).alias("specific"))


def _s19_sql(docs: str = "documents", sep: str = " | ") -> str:
    spec = q(_SPECIFIC).replace("{", "{{").replace("}", "}}")

    def wc(x):
        return f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"

    def strip(x):
        return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    group_issues = f"""list_transform(groups, lambda g, i: list_concat(
        CASE WHEN {strip('coalesce(g.header, {q})')} = '' THEN ['a group is missing its header']
             WHEN list_contains(list_transform(groups[1:i - 1], lambda h: lower({strip("coalesce(h.header, '')")})),
                                lower({strip("coalesce(g.header, '')")}))
               THEN ['duplicate group header: "' || substr({strip("coalesce(g.header, '')")}, 1, 44) || '"']
             ELSE []::VARCHAR[] END,
        CASE WHEN len(list_filter(g.bullets, lambda b: regexp_replace(b, '\\s', '', 'g') <> '')) = 0
             THEN ['group "' || substr({strip("coalesce(g.header, '')")}, 1, 34) || '" has no bullets']
             ELSE []::VARCHAR[] END,
        list_transform(list_filter(g.bullets, lambda b: regexp_replace(b, '\\s', '', 'g') <> ''
                                                        AND {wc('b')} > {L.MAX_BULLET_WORDS}),
                       lambda b: 'bullet of ' || CAST({wc('b')} AS VARCHAR) || ' words (max {L.MAX_BULLET_WORDS}): "'
                                 || substr(b, 1, 64) || '..."')))""".replace("{q}", "''")
    return f"""
WITH l AS (
  SELECT doc_id AS letter_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM {docs}),
g AS (
  SELECT letter_id,
         CASE WHEN len(lines) <= 1 THEN [] ELSE list_transform(lines, lambda ln: struct_pack(
              header := ln, bullets := string_split_regex(ln, '[.!?] '))) END AS groups,
         CASE WHEN len(lines) <= 1 THEN lines ELSE []::VARCHAR[] END AS paragraphs
  FROM l),
x AS (
  SELECT *, flatten(list_transform(groups, lambda g: g.bullets)) AS allb FROM g),
y AS (
  SELECT *, list_filter(allb, lambda b: NOT regexp_matches(b, {spec})) AS vague FROM x)
SELECT letter_id, array_to_string(
  CASE WHEN len(paragraphs) > 0 AND len(groups) = 0 THEN
         CASE WHEN {wc("array_to_string(paragraphs, ' ')")} > {L.MAX_LETTER_WORDS}
              THEN ['too long (' || CAST({wc("array_to_string(paragraphs, ' ')")} AS VARCHAR) || ' words)']
              ELSE []::VARCHAR[] END
       ELSE list_concat(
         CASE WHEN len(groups) < {L.MIN_GROUPS}
              THEN ['only ' || CAST(len(groups) AS VARCHAR) || ' achievement group(s); want {L.MIN_GROUPS}']
              ELSE []::VARCHAR[] END,
         flatten({group_issues}),
         CASE WHEN len(allb) > 0 AND len(vague) * 2 > len(allb)
              THEN [CAST(len(vague) AS VARCHAR) || ' of ' || CAST(len(allb) AS VARCHAR)
                    || ' bullets carry no metric, employer, or named method; e.g. "' || substr(vague[1], 1, 58) || '..."']
              ELSE []::VARCHAR[] END) END, '{sep}') AS issues
FROM y"""


@register("S19_style_issues", oracle=_s19_sql())
def s19(spark, sf):
    return L.style_issues(letters(spark, sf)).select(
        "letter_id", F.array_join("issues", " | ").alias("issues"))


def _a13_sql(docs: str = "documents") -> str:
    scope = q(L.INVENTED_SCOPE.replace("(?iU)", "(?i)")).replace("{", "{{").replace("}", "}}")
    return f"""
WITH b AS {sql_bullets(docs)}, {_J9_BODY},
scope AS (SELECT letter_id, pos, 0 AS k,
                 'invented scope "' || regexp_extract(text, {scope}, 0) || '" in: "' || substr(text, 1, 56) || '..."'
                   AS problem
          FROM b WHERE regexp_matches(coalesce(text, ''), {scope})),
claims AS (SELECT letter_id, string_agg(problem, '; ' ORDER BY pos, k) AS claims
           FROM (SELECT * FROM scope UNION ALL SELECT * FROM nums) GROUP BY letter_id),
t AS ({_s18_sql(sql_bullets(docs))}),
tl AS (SELECT letter_id, array_to_string(list_transform(list_filter(string_split(tells, ' | '), lambda x: x <> ''),
                                                        lambda x: 'AI tell: ' || x), '; ') AS tl FROM t),
st AS ({_s19_sql(docs, '; ')})
SELECT st.letter_id, concat_ws('; ', c.claims, nullif(tl.tl, ''), nullif(st.issues, '')) AS problems,
       c.claims IS NULL AND coalesce(tl.tl, '') = '' AND st.issues = '' AS clean
FROM st LEFT JOIN tl ON tl.letter_id = st.letter_id LEFT JOIN claims c ON c.letter_id = st.letter_id"""


@register("A13_lint_summary", oracle=_a13_sql())
def a13(spark, sf):
    return L.lint_summary(bullets(spark, sf), profiles(spark, sf), letters(spark, sf))
