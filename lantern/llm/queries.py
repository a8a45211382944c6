"""Registered queries of the package, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, language_id, page_text, token_records
from .common import fresh_dir, landed, table_path
from .decontaminate import find_items
from .exact_dedup import exact_dedup
from .hard_negatives import hard_negatives
from .line_dedup import drop_common_lines
from .near_dup import near_duplicates
from .nearest import nearest
from .sharding import assign_shards

LOWER_SQL = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHARD_BYTES = 1 << 20


END_ID = 1


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabularies are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, table))


def op1_token_records(spark, sf_dir):
    """Documents as token records, written, indexed and read back."""
    path = fresh_dir(spark, "token-records")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    token_records.write_records(docs, f"{path}/data", tokenizer_path("word_bpe_49k.json"), END_ID)
    token_records.write_index(spark, f"{path}/data", f"{path}/index")
    first = spark.read.parquet(f"{path}/index/files")
    records = token_records.read_records(spark, f"{path}/data").join(first, "file_no")
    return records.select(F.col("id").alias("doc_id"), (F.col("first") + F.col("file_start")).alias("start"), "n_tokens",
                          F.crc32("ids").alias("ids_crc32"))


def op2_sharding(spark, sf_dir):
    """Shards of at most 1 MiB of text by extendible hashing of doc_id."""
    out = assign_shards(_read(spark, sf_dir, "documents").select("doc_id", "text"), limit_bytes=SHARD_BYTES)
    return out.select("doc_id", "shard", "depth", "n_bytes", "shard_bytes", "shard_rows")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
p AS (SELECT d.*, k.depth, left(bits, k.depth) AS shard
       FROM d, (SELECT unnest(range(0, 61))::INTEGER AS depth) k),
total AS (SELECT depth, shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM p GROUP BY ALL),
fit AS (SELECT p.doc_id, p.n_bytes, p.depth, p.shard, shard_bytes, shard_rows,
               row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS r
        FROM p JOIN total USING (depth, shard) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
SELECT doc_id, shard, depth, n_bytes, shard_bytes, shard_rows FROM fit WHERE r = 1
"""


def op3_language_id(spark, sf_dir):
    """Learned from text and lang of the rows that are not held out; predicted for all."""
    docs, out = _read(spark, sf_dir, "documents"), language_id.held_out()
    sample = language_id.training_sample(docs.where(~out))
    return language_id.identify(docs.select("doc_id", "text", out.alias("held_out")), sample).select(
        "doc_id", "held_out", "lang_pred", "score")


def op4_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item with edits in 5 % of its characters at most."""
    return find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark, sf_dir):
    out = exact_dedup(spark, table_path(sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER_SQL.format(x="coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""


def op6_bpe(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = bpe.build_lexicon(docs, tokenizer_path("byte_bpe_50k.json"))
    out = bpe.decode(bpe.encode(docs, lexicon), lexicon)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_page_text(spark, sf_dir):
    return page_text.extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_near_dup(spark, sf_dir):
    """Documents linked at 85 % of their 3-word shingles or more."""
    out = near_duplicates(_read(spark, sf_dir, "documents"), size=3, threshold=Fraction(85, 100))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: A conversation whose texts are control strings.
MARKED = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(MARKED, turns.schema))
    return chat_format.digests(landed(chat_format.format_turns(turns), "chat-turns"))


def op10_line_dedup(spark, sf_dir):
    out = drop_common_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"),
                      F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, {LOWER_SQL.format(x="trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op11_hard_negatives(spark, sf_dir):
    """Negatives scored between 80 % of a positive and the positive, for every 100th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same,
             list_sum(list_transform(list_zip(a.q, r.q), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v a JOIN v r ON a.id % 100 = 0 AND r.id <> a.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)::INTEGER AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""

def op12_nearest(spark, sf_dir):
    """The 10 nearest found for every 100th vector."""
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op13_collocations(spark, sf_dir):
    """Each language's 2,000 best phrases of 2 to 4 words."""
    return collocations.mine(_read(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {LOWER_SQL.format(x="coalesce(text, '')")} AS t, row_number() OVER () AS doc FROM documents),
p AS (SELECT lang, doc, unnest(x) AS piece, generate_subscripts(x, 1) AS no
      FROM (SELECT lang, doc, regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]') AS x FROM d)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS ws FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
total AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
inner_of AS (SELECT lang, a AS longer, unnest(list_concat([array_to_string(ws[1:k - 1], ' ')], [array_to_string(ws[2:k], ' ')])) AS phrase
             FROM f WHERE k >= 3),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inner_of o ON o.lang = f.lang AND o.phrase = f.phrase AND 100 * o.longer >= 80 * f.a),
cuts AS (SELECT f.lang, f.phrase, f.a, c.i, l.a AS l, r.a AS r, (2000000::HUGEINT * f.a) // (l.a + r.a) AS score
         FROM f JOIN (SELECT unnest([1, 2, 3]) AS i) c ON c.i < f.k
         JOIN f l ON l.lang = f.lang AND l.phrase = array_to_string(f.ws[1:c.i], ' ')
         JOIN f r ON r.lang = f.lang AND r.phrase = array_to_string(f.ws[c.i + 1:f.k], ' ')
         WHERE f.k >= 2 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = f.lang AND gone.phrase = f.phrase)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best JOIN total USING (lang) QUALIFY rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_decontamination": op4_decontamination,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_page_text": op7_page_text,
    "op8_near_dup": op8_near_dup,
    "op9_chat_format": op9_chat_format,
    "op10_line_dedup": op10_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_nearest": op12_nearest,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op2_sharding": OP2_SQL, "op5_exact_dedup": OP5_SQL, "op10_line_dedup": OP10_SQL,
                           "op11_hard_negatives": OP11_SQL, "op13_collocations": OP13_SQL}
