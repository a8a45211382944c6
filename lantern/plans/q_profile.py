"""Skills inventory and profile queries over the ``skills`` adapter (R18, A12,
U3, J11, S30, S23, T7, S22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators import profile as Pr
from lantern.plans.registry import q, register
from lantern.plans.tables import adapter

# Run setting: the category order of the general resume's skill lines.
SKILL_ORDER = ["STANDARD", "LARGE", "ECONOMY", "Other"]


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


SQL_R18 = f"""(
SELECT inventory, row_seq,
       CASE WHEN starts_with(lower(cat), 'certification') THEN 'certification' ELSE 'skill' END AS kind,
       CASE WHEN starts_with(lower(cat), 'certification') THEN NULL ELSE cat END AS category,
       CASE WHEN starts_with(lower(cat), 'certification') THEN sk
            ELSE sk || CASE WHEN pr <> '' THEN ' (' || pr || ')' ELSE '' END
                    || CASE WHEN nt <> '' THEN ' [' || nt || ']' ELSE '' END END AS label
FROM (SELECT inventory, row_seq, {_strip("coalesce(skill, '')")} AS sk,
             lower({_strip("coalesce(have_it, '')")}) AS hv,
             CASE WHEN {_strip("coalesce(category, 'Other')")} = '' THEN 'Other'
                  ELSE {_strip("coalesce(category, 'Other')")} END AS cat,
             {_strip("coalesce(proficiency, '')")} AS pr, {_strip("coalesce(notes, '')")} AS nt
      FROM {{skills}})
WHERE sk <> '' AND hv IN ('yes', 'y', 'true', '1'))"""


@register("R18_skills_table", oracle=f"SELECT * FROM {SQL_R18}")
def r18(spark, sf):
    return Pr.skills_table(adapter(spark, sf, "skills"))


@register("A12_skills_by_category", oracle=f"""
SELECT inventory, category, first_seq, labels,
       row_number() OVER (PARTITION BY inventory ORDER BY first_seq) AS category_pos
FROM (SELECT inventory, category, min(row_seq) AS first_seq, string_agg(label, ' | ' ORDER BY row_seq) AS labels
      FROM {SQL_R18} WHERE kind = 'skill' GROUP BY inventory, category)""")
def a12(spark, sf):
    g = Pr.skills_by_category(Pr.skills_table(adapter(spark, sf, "skills")))
    return g.select("inventory", "category", "first_seq", F.array_join("labels", " | ").alias("labels"),
                    "category_pos")


SQL_U3 = f"""(
SELECT inventory, string_agg(v, ' | ' ORDER BY src, seq) AS certifications FROM (
  SELECT inventory, v, arg_min(src, (src, seq)) AS src, arg_min(seq, (src, seq)) AS seq FROM (
    SELECT inventory, 0 AS src, row_seq AS seq, label AS v FROM {SQL_R18} WHERE kind = 'certification'
    UNION ALL SELECT inventory, 1 AS src, seq, cert AS v FROM {{profile_certs}})
  GROUP BY inventory, v)
GROUP BY inventory)"""


@register("U3_cert_union", oracle=f"SELECT * FROM {SQL_U3}")
def u3(spark, sf):
    t = Pr.skills_table(adapter(spark, sf, "skills"))
    first = t.where(F.col("kind") == "certification").select("inventory", F.col("row_seq").alias("seq"),
                                                             F.col("label").alias("cert"))
    u = Pr.ordered_distinct_union(first, adapter(spark, sf, "profile_certs"), "inventory", "cert")
    return u.select("inventory", F.array_join("values", " | ").alias("certifications"))


@register("J11_profile_skills", oracle=f"""
WITH inv AS (SELECT DISTINCT inventory FROM {{skills}}),
has AS (SELECT inventory, count_if(kind = 'skill') AS n_skills, count_if(kind = 'certification') AS n_certs
        FROM {SQL_R18} GROUP BY inventory),
own AS (SELECT inventory, string_agg(cert, ' | ' ORDER BY seq) AS own FROM {{profile_certs}} GROUP BY inventory),
cats AS (SELECT inventory, count(DISTINCT category) AS n_categories FROM {SQL_R18} WHERE kind = 'skill'
         GROUP BY inventory)
SELECT inv.inventory,
       CASE WHEN coalesce(n_skills, 0) + coalesce(n_certs, 0) > 0 THEN 'table' ELSE 'profile' END AS skills_source,
       CAST(CASE WHEN coalesce(n_skills, 0) + coalesce(n_certs, 0) > 0 THEN coalesce(n_categories, 0) ELSE 0 END
            AS BIGINT) AS n_categories,
       CASE WHEN coalesce(n_skills, 0) + coalesce(n_certs, 0) > 0 AND coalesce(n_certs, 0) > 0
            THEN u.certifications ELSE coalesce(own.own, '') END AS certifications
FROM inv LEFT JOIN has USING (inventory) LEFT JOIN own USING (inventory) LEFT JOIN cats USING (inventory)
LEFT JOIN {SQL_U3} u USING (inventory)""")
def j11(spark, sf):
    s = adapter(spark, sf, "skills")
    inv = s.select("inventory").distinct()
    return Pr.profile_skills(Pr.skills_table(s), adapter(spark, sf, "profile_certs"), inv)


@register("S30_short_skill", oracle=f"""
SELECT inventory, row_seq, {_strip("coalesce(category, '')")} AS category,
       {_strip(f"split_part(split_part({_strip('skill')}, ' (', 1), ':', 1)")} AS skill
FROM {{skills}}
WHERE lower({_strip("coalesce(have_it, '')")}) = 'yes' AND {_strip("coalesce(skill, '')")} <> ''
  AND NOT starts_with(lower({_strip("coalesce(category, '')")}), 'certification')""")
def s30(spark, sf):
    return Pr.short_skills(adapter(spark, sf, "skills"))


# S23 in SQL: the fold as list_reduce over a text state "keys<RS>items", each
# key and item led by a GS character (so an empty key is still a key).
def _sql_prefix_dedupe(items: str) -> str:
    keys = "string_split(split_part(acc, chr(30), 1), chr(29))[2:]"
    k = "regexp_replace(lower(x), 's+$', '')"
    step = (f"CASE WHEN len(list_filter({keys}, lambda p: starts_with({k}, p) OR starts_with(p, {k}))) > 0 "
            f"THEN acc ELSE split_part(acc, chr(30), 1) || chr(29) || {k} || chr(30) "
            f"|| split_part(acc, chr(30), 2) || chr(29) || x END")
    return (f"string_split(split_part(list_reduce({items}, lambda acc, x: {step}, chr(30)), chr(30), 2), "
            f"chr(29))[2:]")


SQL_SHORT = f"""(
SELECT inventory, row_seq, {_strip("coalesce(category, '')")} AS category,
       {_strip(f"split_part(split_part({_strip('skill')}, ' (', 1), ':', 1)")} AS skill
FROM {{skills}}
WHERE lower({_strip("coalesce(have_it, '')")}) = 'yes' AND {_strip("coalesce(skill, '')")} <> ''
  AND NOT starts_with(lower({_strip("coalesce(category, '')")}), 'certification'))"""
SQL_ITEMS = f"""(SELECT inventory, category, list(skill ORDER BY row_seq) AS items FROM {SQL_SHORT}
                 GROUP BY inventory, category)"""


def _t7_sql() -> str:
    pos = "CASE " + " ".join(f"WHEN category = {q(c)} THEN {i}" for i, c in enumerate(SKILL_ORDER)) + " END"
    return f"""
SELECT inventory, {pos} AS line_pos,
       category || ': ' || array_to_string({_sql_prefix_dedupe('items')}[1:{Pr.PER_CATEGORY}], ', ') AS line
FROM {SQL_ITEMS} WHERE {pos} IS NOT NULL
UNION ALL
SELECT inventory, {len(SKILL_ORDER)} AS line_pos, '{Pr.INDUSTRY}: ' || array_to_string(items, ', ') AS line
FROM {SQL_ITEMS} WHERE category = '{Pr.INDUSTRY}'"""


@register("T7_skill_line_order", oracle=_t7_sql())
def t7(spark, sf):
    return Pr.skill_lines(Pr.short_skills(adapter(spark, sf, "skills")), SKILL_ORDER)


@register("S23_prefix_dedupe", oracle=f"""
SELECT inventory, category, array_to_string({_sql_prefix_dedupe('items')}, ', ') AS kept FROM {SQL_ITEMS}""")
def s23(spark, sf):
    short = Pr.short_skills(adapter(spark, sf, "skills"))
    g = short.groupBy("inventory", "category").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row_seq", "skill"))), lambda x: x["skill"]).alias("items"))
    return g.select("inventory", "category", F.array_join(Pr.prefix_dedupe(F.col("items")), ", ").alias("kept"))


_CAT = q("^([^:]{3,40}):\\s*(.+)$").replace("{", "{{").replace("}", "}}")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


# The fold over terms as a recursion: one step per term of an inventory, with the terms
# seen so far and those kept in each category.
SQL_S22 = f"""
WITH RECURSIVE lines AS (
  SELECT inventory, min(row_seq) AS seq,
         CASE WHEN category = '' THEN '' ELSE category || ': ' END || string_agg(skill, ', ' ORDER BY row_seq, skill) AS l
  FROM {{skills}} GROUP BY inventory, category),
s AS (SELECT inventory, list_transform(list(l ORDER BY seq, l), lambda x:
        {_strip_sql("regexp_replace(x, '\\s*\\(([^)]*)\\)', ', \\1', 'g')")}) AS s FROM lines GROUP BY inventory),
c AS (SELECT *, len(s) >= 3 AND len(list_filter(s, lambda x: NOT regexp_matches(x, {_CAT}))) = 0 AS categorised FROM s),
cats AS (SELECT inventory, unnest(s[1:{Pr.MAX_SKILL_CATEGORIES}]) AS line, generate_subscripts(s[1:{Pr.MAX_SKILL_CATEGORIES}], 1) AS cat
         FROM c WHERE categorised),
split AS (SELECT inventory, cat, {_strip_sql(f"regexp_extract(line, {_CAT}, 1)")} AS label,
                 list_filter(list_transform(string_split(regexp_extract(line, {_CAT}, 2), ','),
                   lambda t: regexp_replace(t, '^[ .;]+|[ .;]+$', '', 'g')), lambda t: t <> '') AS ts FROM cats),
terms AS (SELECT *, row_number() OVER (PARTITION BY inventory ORDER BY cat, k) AS i
          FROM (SELECT inventory, cat, unnest(ts) AS term, generate_subscripts(ts, 1) AS k FROM split)),
st AS (
  SELECT inventory, 0::BIGINT AS i, []::VARCHAR[] AS seen, []::STRUCT(cat BIGINT, term VARCHAR)[] AS kept
  FROM c WHERE categorised
  UNION ALL
  SELECT st.inventory, t.i,
         CASE WHEN list_contains(seen, lower(t.term)) OR len(list_filter(kept, lambda x: x.cat = t.cat)) >= {Pr.MAX_TERMS_PER_CATEGORY}
              THEN seen ELSE list_append(seen, lower(t.term)) END,
         CASE WHEN list_contains(seen, lower(t.term)) OR len(list_filter(kept, lambda x: x.cat = t.cat)) >= {Pr.MAX_TERMS_PER_CATEGORY}
              THEN kept ELSE list_append(kept, struct_pack(cat := t.cat::BIGINT, term := t.term)) END
  FROM st JOIN terms t ON t.inventory = st.inventory AND t.i = st.i + 1),
fin AS (SELECT inventory, arg_max(kept, i) AS kept FROM st GROUP BY inventory),
outl AS (SELECT f.inventory, p.cat, p.label || ': ' || array_to_string(list_transform(
           list_filter(f.kept, lambda x: x.cat = p.cat), lambda x: x.term), ', ') AS line
         FROM fin f JOIN split p ON p.inventory = f.inventory
         WHERE len(list_filter(f.kept, lambda x: x.cat = p.cat)) > 0),
done AS (SELECT inventory, list(line ORDER BY cat) AS out FROM outl GROUP BY inventory)
SELECT c.inventory, CASE WHEN categorised THEN coalesce(done.out, []::VARCHAR[]) ELSE list_filter(s, lambda x, i:
         x <> '' AND NOT list_contains(list_transform(s[1:i - 1], lambda y: lower(y)), lower(x))) END AS skills
FROM c LEFT JOIN done ON done.inventory = c.inventory"""


def skill_lines(spark, sf):
    """Each inventory as a resume's skills block: one 'Category: a, b (x)' line per
    category (or the bare names when the category is blank), normalised."""
    per_cat = adapter(spark, sf, "skills").groupBy("inventory", "category").agg(
        F.min("row_seq").alias("seq"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_seq", "skill"))),
                                 lambda x: x["skill"]), ", ").alias("terms"))
    line = F.when(F.col("category") == "", F.col("terms")).otherwise(F.concat("category", F.lit(": "), "terms"))
    blocks = per_cat.groupBy("inventory").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", line.alias("l")))), lambda x: x["l"]).alias("skills"))
    return blocks.select("inventory", Pr.normalize_skills(F.col("skills")).alias("skills"))


@register("S22_normalise_skills", oracle=f"SELECT inventory, array_to_string(skills, ' | ') AS skills FROM ({SQL_S22})")
def s22(spark, sf):
    return skill_lines(spark, sf).select("inventory", F.array_join("skills", " | ").alias("skills"))
