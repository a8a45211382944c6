"""Pay queries (S10, S11, S13) over the ``pay_texts`` adapter and pay objects
built from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators import pay as P
from lantern.plans.registry import q, register
from lantern.plans.tables import adapter


def qf(s: str) -> str:
    return q(s).replace("{", "{{").replace("}", "}}")


_PAT = P.SALARY_RANGE


def _g(m, i):
    return f"regexp_extract({m}, {qf(_PAT)}, {i})"


def _val(raw, k):
    return f"CASE WHEN {k} <> '' OR {raw} < 1000 THEN CAST(trunc({raw} * 1000) AS BIGINT) ELSE CAST(trunc({raw}) AS BIGINT) END"


_M = "split_part(seg, chr(2), 1)"
_RAW_LO = f"CAST(replace({_g(_M, 1)}, ',', '') AS DOUBLE)"
_RAW_HI = f"CAST(replace({_g(_M, 4)}, ',', '') AS DOUBLE)"
_LO = _val(_RAW_LO, _g(_M, 2))
_HI = _val(_RAW_HI, _g(_M, 5))
_UNIT = f"lower({_g(_M, 3)})"
_BEFORE = "right(replace(array_to_string(segs[1:i], ''), chr(2), ''), 60)"
_AFTER = ("left(replace(split_part(seg, chr(2), 2) || coalesce(array_to_string(segs[i + 2:], ''), ''), "
          "chr(2), ''), 30)")
_KEEP = (f"NOT (starts_with({_UNIT}, 'hr') OR starts_with({_UNIT}, 'hour') OR starts_with({_UNIT}, 'mo') "
         f"OR starts_with({_UNIT}, 'month')) "
         f"AND NOT regexp_matches({_AFTER}, {qf('(?i)' + P.RATE_TRAILING)}) "
         f"AND NOT ((contains({_g(_M, 1)}, '.') OR contains({_g(_M, 4)}, '.')) AND ({_RAW_LO} < 1000 OR {_RAW_HI} < 1000)) "
         f"AND NOT ({_LO} > {_HI} OR {_HI} < 30000 OR {_HI} > 2000000)")
_CTX = (f"starts_with({_UNIT}, 'yr') OR starts_with({_UNIT}, 'year') "
        f"OR regexp_matches({_BEFORE}, {qf('(?i)' + P.PAY_CONTEXT)}) "
        f"OR regexp_matches({_AFTER}, {qf('(?i)' + P.ANNUAL_TRAILING)})")

SQL_S10 = f"""
WITH s AS (
  SELECT text_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\\x01\\x02]', '', 'g'),
                                              {qf(_PAT)}, chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS segs
  FROM {{pay_texts}}),
c AS (
  SELECT text_id, list_filter(list_transform(segs[2:], lambda seg, i:
           CASE WHEN {_KEEP} THEN struct_pack(in_context := ({_CTX}), low := {_LO}, high := {_HI}) END),
         lambda x: x IS NOT NULL) AS cands
  FROM s),
p AS (SELECT text_id, coalesce(list_filter(cands, lambda x: x.in_context)[1], cands[1]) AS pick FROM c)
SELECT text_id, pick.low AS salary_low, pick.high AS salary_high FROM p
"""


@register("S10_salary_range", oracle=SQL_S10)
def s10(spark, sf):
    return P.salary_range(adapter(spark, sf, "pay_texts")).select("text_id", "salary_low", "salary_high")


@register("S13_seniority_rule", oracle=f"""
SELECT text_id, CASE WHEN salary_high IS NULL THEN 'no pay stated'
                     WHEN salary_high >= {P.SALARY_FLOOR} THEN 'at or above floor' ELSE 'below floor' END AS rule,
       coalesce(salary_high >= {P.SALARY_FLOOR}, false) AS overqualification_forced_off
FROM ({SQL_S10})""")
def s13(spark, sf):
    d = P.salary_range(adapter(spark, sf, "pay_texts"))
    rule, off = P.seniority()
    return d.select("text_id", rule.alias("rule"), off.alias("overqualification_forced_off"))


_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN')"
_INNER = "CASE WHEN json_type(j, '$.value') = 'OBJECT' THEN json_extract(j, '$.value') ELSE j END"


def _end(a, b):
    return (f"CASE WHEN json_exists(inr, '$.{a}') THEN json_extract(inr, '$.{a}') "
            f"ELSE json_extract(inr, '$.{b}') END")


def _truthy(on, path):
    s = f"json_extract_string({on}, '{path}')"
    return f"CASE WHEN {s} IS NOT NULL AND {s} NOT IN ('', '0', 'false') THEN {s} END"


@register("S11_pay_object", oracle=f"""
SELECT pay_id,
  CASE WHEN ok THEN CAST(trunc(CAST(lo AS DOUBLE)) AS BIGINT) END AS low,
  CASE WHEN ok THEN CAST(trunc(CAST(hi AS DOUBLE)) AS BIGINT) END AS high,
  CASE WHEN ok THEN lower(coalesce({_truthy('inr', '$.unitOfWork')}, {_truthy('inr', '$.unitText')},
                                   {_truthy('j', '$.unitOfWork')}, 'YEAR')) END AS unit
FROM (SELECT *, json_type(j) = 'OBJECT' AND coalesce(json_type(lo) IN {_NUM}, false)
                AND coalesce(json_type(hi) IN {_NUM}, false) AS ok
      FROM (SELECT *, {_end('min', 'minValue')} AS lo, {_end('max', 'maxValue')} AS hi
            FROM (SELECT pay_id, j, {_INNER} AS inr FROM (SELECT pay_id, CAST(pay AS JSON) AS j
                                                            FROM {{pay_objects}}))))""")
def s11(spark, sf):
    o = adapter(spark, sf, "pay_objects").withColumn("p", P.pay_object("pay"))
    return o.select("pay_id", F.col("p.low").alias("low"), F.col("p.high").alias("high"),
                    F.col("p.unit").alias("unit"))
