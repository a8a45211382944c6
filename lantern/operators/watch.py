"""Company watchlist matching (J5) and canonical employer order.

Both are theta joins ("a is a prefix of b", "a occurs in b") turned into
equi-joins. J5: the prefixes of the found name are joined with the watched short
names, and the prefixes of the short names with the found name; one path for a
watch list of any length. J6: entries meet their own profile's canonical employers
in one equi-join on the profile.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def watch_short(name: str) -> str:
    """The compact key of a watched company: a few suffix words removed."""
    n = (name.lower().replace("the ", "").replace(" company", "")
         .replace(" inc", "").replace(" corporation", ""))
    return re.sub(r"[^a-z0-9]", "", n)


def watch_table(spark: SparkSession, companies: list[str]) -> DataFrame:
    rows = [(i, c, watch_short(c)) for i, c in enumerate(companies)]
    return spark.createDataFrame(rows, "watch_idx int, watched string, short string")


def watchlist_matches(found: DataFrame, watch: DataFrame, key: str = "key") -> DataFrame:
    """Found postings whose compact company and a watched short name are
    prefixes of one another (either way), deduplicated by ``key`` keeping the
    first watched company (list order) and then the first posting order
    (``seq``, unique). ``found`` needs key, seq, company; ``watch`` is watch_table.

    Only key, seq and the compact name are fanned out, to the prefixes of lengths that
    the watch list has; the postings' other columns join the winners."""
    f = (found.select(F.col(key).alias("_key"), F.col("seq").alias("_seq"),
                      F.regexp_replace(F.lower(F.coalesce("company", F.lit(""))), "[^a-z0-9]", "").alias("_found"))
         .where(F.col("_found") != ""))
    # (a) short is a prefix of found: found's prefixes of the watched lengths, on equality
    lengths = watch.agg(F.collect_set(F.length("short")).alias("n")).scalar()
    f = f.withColumn("_lengths", lengths)
    probes = F.transform(F.filter("_lengths", lambda n: n <= F.length("_found")), lambda n: F.substr("_found", F.lit(1), n))
    a = (f.select("_key", "_seq", F.explode(probes).alias("_p"))
         .join(watch.select("watch_idx", "watched", F.col("short").alias("_p")), "_p").drop("_p"))
    # (b) found is a proper prefix of short: the watched names' prefixes, the same way
    pref = (watch.select("watch_idx", "watched", "short", F.explode(F.sequence(F.lit(0), F.length("short") - 1)).alias("_n"))
            .where("short <> ''").select("watch_idx", "watched", F.substr("short", F.lit(1), F.col("_n")).alias("_found")))
    b = f.join(pref.where("_found <> ''"), "_found").select(*a.columns)
    best = (a.unionByName(b).groupBy("_key")
            .agg(F.min(F.struct("watch_idx", "_seq", "watched")).alias("_r")).select("_key", "_r._seq", "_r.watched"))
    return (found.join(best, F.col(key).eqNullSafe(F.col("_key")) & (F.col("seq") == F.col("_seq")))
            .drop("_key", "_seq"))


def canonical_match(entries: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per resume entry, the first canonical employer index (profile order)
    whose name occurs in the entry's company, or that contains the entry's
    company up to its first '('. ``entries``: profile_id, entry_id, company;
    ``canonical``: profile_id, idx, company. Adds ``canon_idx`` and
    ``canon_company`` (null when nothing matches).

    A profile's employers travel as one list (a person's employers) to its entries, by one
    merge join on the profile, and every entry tests them where it lies. Neither side is
    ever broadcast: both grow with the profiles. Entries that share an id share the first
    index any of them matches."""
    name = F.lower(F.coalesce("company", F.lit("")))
    e = entries.withColumn("_name", name).withColumn(
        "_head", F.regexp_replace(F.split_part(F.col("_name"), F.lit("("), F.lit(1)), "(?U)^\\s+|\\s+$", ""))
    lists = canonical.groupBy("profile_id").agg(F.collect_list(
        F.struct("idx", name.alias("c"), F.col("company").alias("canon"))).alias("_known"))
    # the empty string occurs in everything: an empty canonical name matches
    # every entry, an empty head matches every canonical
    hit = F.filter("_known", lambda x: F.col("_name").contains(x["c"]) | x["c"].contains(F.col("_head")))
    e = (e.join(lists.hint("merge"), "profile_id", "left")
         .withColumn("_idx", F.array_min(F.transform(hit, lambda x: x["idx"])))
         .withColumn("_own", F.when(F.col("_idx").isNotNull() & F.col("entry_id").isNotNull(), F.struct(
             F.col("_idx").alias("canon_idx"),
             F.transform(F.filter("_known", lambda x: x["idx"] == F.col("_idx")), lambda x: x["canon"]).alias("named"))))
         .drop("_known", "_idx", "_name", "_head"))
    best = e.withColumn("_best", F.min("_own").over(Window.partitionBy("profile_id", "entry_id")))
    rest = [c for c in entries.columns if c not in ("profile_id", "entry_id")]
    return best.select("profile_id", "entry_id", *rest, F.col("_best.canon_idx").alias("canon_idx"),
                       F.explode_outer("_best.named").alias("canon_company"))


def experience_order(matched: DataFrame, n_canonical: DataFrame) -> DataFrame:
    """Stable order of a resume's entries by canonical index, unknown
    employers last (entry order kept among equals); the company is pinned to
    the canonical spelling when matched. ``n_canonical``: profile_id, n."""
    m = matched.join(n_canonical.hint("merge"), "profile_id", "left")
    rank = F.coalesce(F.col("canon_idx"), F.coalesce(F.col("n"), F.lit(0)))
    return (m.withColumn("rank", rank)
            .withColumn("company", F.coalesce(F.col("canon_company"), F.col("company")))
            .drop("n"))
