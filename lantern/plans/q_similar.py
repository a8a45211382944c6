"""Near-duplicate query (J8) over documents vs benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lantern.operators.similar import near_duplicates
from lantern.plans.registry import register
from lantern.plans.tables import adapter, read_table


def new_claims(spark, sf):
    """Every line of every document is a new claim to check."""
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        F.struct("doc_id", "pos").alias("new_id"), "text")


def bullets(spark, sf):
    b = read_table(spark, sf, "benchmark")
    return b.select("item_id", F.posexplode(F.split("text", "[.]")).alias("pos", "text")).select(
        F.struct("item_id", "pos").alias("bullet_id"), "text")


_WS = "list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z]{{{{4,}}}}', 0))"

SQL_J8 = f"""
WITH n AS (SELECT doc_id, pos - 1 AS line_pos, doc_id::VARCHAR || ':' || pos::VARCHAR AS new_id, {_WS.format(x='line')} AS ws
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
a AS (SELECT acc_id, title, {_WS.format(x='title')} AS ws FROM {{recorded_accomplishments}}),
b AS (SELECT item_id, pos - 1 AS bpos, row_number() OVER (ORDER BY item_id, pos) AS bullet_id, line AS text, {_WS.format(x='line')} AS ws
      FROM (SELECT item_id, unnest(string_split(text, '.')) AS line,
                   generate_subscripts(string_split(text, '.'), 1) AS pos FROM benchmark)),
acc AS (
  SELECT n.new_id, min(n.doc_id) AS doc_id, min(n.line_pos) AS line_pos, min(a.acc_id) AS match_item, 0 AS match_pos, arg_min(a.title, a.acc_id) AS matched
  FROM n JOIN a ON len(n.ws) > 0 AND len(a.ws) > 0
   AND len(list_intersect(n.ws, a.ws)) / len(list_distinct(list_concat(n.ws, a.ws))) > 0.5
  GROUP BY n.new_id),
bul AS (
  SELECT n.new_id, min(n.doc_id) AS doc_id, min(n.line_pos) AS line_pos, arg_min(b.item_id, b.bullet_id) AS match_item, arg_min(b.bpos, b.bullet_id) AS match_pos,
         substr(arg_min(b.text, b.bullet_id), 1, 60) || '...' AS matched
  FROM n JOIN b ON len(n.ws) > 0 AND len(b.ws) > 0
   AND len(list_intersect(n.ws, b.ws)) >= greatest(3.0, len(n.ws) * 0.6)
  GROUP BY n.new_id)
SELECT doc_id, line_pos, 'accomplishment' AS kind, match_item, match_pos, matched FROM acc
UNION ALL
SELECT doc_id, line_pos, 'bullet' AS kind, match_item, match_pos, matched FROM bul WHERE new_id NOT IN (SELECT new_id FROM acc)
"""


@register("J8_near_duplicate", oracle=SQL_J8)
def j8(spark, sf):
    acc = adapter(spark, sf, "recorded_accomplishments").select(
        F.struct(F.col("acc_id").alias("item_id"), F.lit(0).alias("pos")).alias("acc_id"), "title")
    out = near_duplicates(new_claims(spark, sf), acc, bullets(spark, sf))
    return out.select("new_id.doc_id", F.col("new_id.pos").alias("line_pos"), "kind",
                      F.col("match_id.item_id").alias("match_item"), F.col("match_id.pos").alias("match_pos"), "matched")
