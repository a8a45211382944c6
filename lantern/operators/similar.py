"""Near-duplicate detection by word sets (J8) as an exact set-similarity join.

Words are ``[a-z]{4,}`` of the lower-cased text. Two tests, as in the
reference: Jaccard > 0.5 against accomplishment titles, and overlap >=
max(3, 0.6 * |new|) against recorded bullets.

Every set is written in one global order of words, rare ones first. If two sets must
share ``c`` words, their first common word stands among the first |x| - c + 1 of each, so
only those prefixes are join keys and the words that are in everything never are. The
join carries both sets along:

- a pair is met once for each common prefix word and kept only at the first one, so
  nothing has to be made distinct;
- there the positions bound the overlap (1 + what is left of the shorter rest), and pairs
  that cannot reach ``c`` go before anything is intersected;
- the rests are intersected for what is left, in place, without fetching a set again.

Rarity is read from ``SLOTS`` counters of hashed recorded words, one array of fixed size
that reaches the executors as a scalar subquery: any order is exact, and a word whose
counter is 0 is on no recorded set at all and needs no place in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-z]{4,}"
SLOTS = 1 << 16


def word_set(text) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def _slot(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int")


def _counters(recorded: DataFrame) -> Column:
    """Recorded words per slot, as one array of ``SLOTS`` numbers."""
    words = recorded.select(F.explode("ws").alias("w")).select(_slot(F.col("w")).alias("slot"), F.lit(1).alias("n"))
    every = recorded.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"), F.lit(0).alias("n"))
    sums = words.unionByName(every).groupBy("slot").agg(F.sum("n").alias("n"))
    return sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "n"))), lambda s: s["n"]).alias("n")).scalar()


def _ordered(sets: DataFrame, counters: Column) -> DataFrame:
    """``sets`` with ``size`` and ``ranked``: the words that a recorded set may hold, rare ones first."""
    rated = F.transform("ws", lambda w: F.struct(F.get(F.col("_counters"), _slot(w)).alias("n"), w.alias("w")))
    return (sets.withColumn("_counters", counters).withColumn("size", F.size("ws"))
            .withColumn("ranked", F.transform(F.array_sort(F.filter(rated, lambda s: s["n"] > 0)), lambda s: s["w"]))
            .drop("_counters", "ws"))


def _ceil(x: Column) -> Column:
    return F.ceil(x - F.lit(1e-9)).cast("int")


def near_duplicates(new: DataFrame, accomplishments: DataFrame, bullets: DataFrame,
                    jaccard: float = 0.5) -> DataFrame:
    """For each ``new`` row (new_id, text) the first accomplishment
    (acc_id order) whose title word set has Jaccard > ``jaccard``, else the
    first bullet (bullet_id order) sharing >= max(3, 0.6*|new|) words; output
    (new_id, kind, match_id, matched) for rows that have a match. ``acc_id`` and
    ``bullet_id`` have one type. One row is matched for each distinct word set: the
    answer depends on the set alone, and lines repeat a lot."""
    keyed = new.select("new_id", F.array_join(F.array_sort(word_set(F.col("text"))), " ").alias("_set")).where("_set <> ''")
    sets = keyed.select("_set").distinct().select("_set", F.split("_set", " ").alias("ws"))
    titles = accomplishments.select(F.lit(0).alias("kind"), F.col("acc_id").alias("match_id"), F.col("title").alias("matched"),
                                    word_set(F.col("title")).alias("ws"))
    lines = bullets.select(F.lit(1).alias("kind"), F.col("bullet_id").alias("match_id"),
                           F.concat(F.substring("text", 1, 60), F.lit("...")).alias("matched"), word_set(F.col("text")).alias("ws"))
    recorded = titles.unionByName(lines).where(F.size("ws") > 0)
    counters = _counters(recorded)

    # the fewest common words that can do: of a title for its own size, of a bullet 3
    least = F.when(F.col("kind") == 0, _ceil(F.col("size") * jaccard)).otherwise(F.lit(3))
    r = _ordered(recorded, counters).withColumn("least", F.greatest(least, F.lit(1)))
    r = r.select("kind", "match_id", "matched", F.col("size").alias("r_size"), F.col("ranked").alias("r_words"),
                 F.posexplode(F.slice("ranked", 1, F.greatest(F.size("ranked") - F.col("least") + 1, F.lit(0)))).alias("j", "w"))
    n = _ordered(sets, counters)
    of_title, of_line = _ceil(F.col("size") * jaccard), F.greatest(F.lit(3), _ceil(F.col("size") * 0.6))
    n = n.select("_set", F.col("size").alias("n_size"), F.col("ranked").alias("n_words"), of_line.alias("n_least"),
                 F.posexplode(F.slice("ranked", 1, F.greatest(
                     F.size("ranked") - F.least(F.greatest(of_title, F.lit(1)), of_line) + 1, F.lit(0)))).alias("i", "w"))

    # shared > t * union is shared * (1 + t) > t * (sizes); common words after these positions
    both = F.col("n_size") + F.col("r_size")
    most = F.least(F.size("n_words") - F.col("i"), F.size("r_words") - F.col("j"))
    reaches = lambda shared: F.when(F.col("kind") == 0, shared / (both - shared) > jaccard).otherwise(shared >= F.col("n_least"))
    met = n.join(r, "w").where(reaches(most))
    first = ~F.arrays_overlap(F.slice("n_words", 1, F.col("i")), F.slice("r_words", 1, F.col("j")))
    shared = 1 + F.size(F.array_intersect(F.slice("n_words", F.col("i") + 2, F.size("n_words")), F.slice("r_words", F.col("j") + 2, F.size("r_words"))))
    found = (met.where(first).withColumn("shared", shared).where(reaches(F.col("shared")))
             .groupBy("_set").agg(F.min(F.struct("kind", "match_id", "matched")).alias("m")))
    return keyed.join(found, "_set").select(
        "new_id", F.when(F.col("m.kind") == 0, F.lit("accomplishment")).otherwise(F.lit("bullet")).alias("kind"),
        F.col("m.match_id").alias("match_id"), F.col("m.matched").alias("matched"))
