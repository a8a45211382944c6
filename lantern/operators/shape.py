"""Resume shaping (W7, W8, W9, W10, T6) on exploded bullet rows.

Bullets are rows ``(resume_id, role_pos, bullet_idx, text)``; every window
partitions by ``resume_id`` (one document), so work spreads by resume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lantern.functions.predicates import one_spaced, word_count

# Fixed values (tuning defaults): bullets kept per role by position, newest
# first; roles beyond the list keep BULLETS_TAIL; word budgets.
BULLETS_BY_POSITION = [6, 6, 3, 3, 5, 3]
BULLETS_TAIL = 2
MAX_RESUME_WORDS = 900
MAX_SUMMARY_WORDS = 80


def summary_trim(summary, max_words: int = MAX_SUMMARY_WORDS) -> Column:
    """Over ``max_words`` words -> whole sentences while the running word
    total stays within the limit (always the first); whitespace normalised.

    The sentences that fit end within the first ``max_words`` words, so only that head is
    searched for the last sentence end; where it has none, the first sentence is longer."""
    s = F.coalesce(summary if isinstance(summary, Column) else F.col(summary), F.lit(""))

    def cut(t):
        head = F.substring_index(t["text"], " ", max_words)
        fits = F.regexp_extract(F.concat(head, F.lit(" ")), "(?s)^(.*[.!?]) ", 1)
        first = F.regexp_extract(F.concat(t["text"], F.lit(" ")), "(?s)^(.*?[.!?]) ", 1)
        return (F.when(head == t["text"], t["own"]).when(fits != "", fits)
                .when(first != "", first).otherwise(t["text"]))

    # bound by a lambda, so that the text is normalised once
    return F.transform(F.array(F.struct(s.alias("own"), one_spaced(s).alias("text"))), cut)[0]


def bullet_cap(position: Column) -> Column:
    """Cap for a role at ``position`` (0 = newest)."""
    cap = F.lit(BULLETS_TAIL)
    for i in reversed(range(len(BULLETS_BY_POSITION))):
        cap = F.when(position == i, F.lit(BULLETS_BY_POSITION[i])).otherwise(cap)
    return cap


def cap_bullets(bullets: DataFrame) -> DataFrame:
    """Keep the first n bullets of each role, n by the role's position."""
    return bullets.where(F.col("bullet_idx") < bullet_cap(F.col("role_pos")))


def word_budget(bullets: DataFrame, other_words: DataFrame, max_words: int = MAX_RESUME_WORDS,
                max_drops: int | None = None) -> DataFrame:
    """Drop bullets from the oldest role's end (never a role's first
    bullet) while the resume is over ``max_words`` (at most ``max_drops`` bullets, if given).

    The loop is a removal order (role desc, bullet desc, bullet > 0): the r-th
    candidate goes iff r <= max_drops and the total minus the words of the
    candidates before it is still over the budget. ``other_words`` gives
    (resume_id, words) of summary, skills and education.
    """
    b = bullets.withColumn("_w", word_count(F.col("text")))
    # other_words has one row per resume: a plain equi-join; the resume total
    # is a window sum over the same partitioning as the removal order below,
    # so the whole operator is one shuffle and one sort.
    b = b.join(other_words.select("resume_id", F.col("words").alias("_ow")).hint("merge"), "resume_id", "left")
    b = b.withColumn("_total", F.sum("_w").over(Window.partitionBy("resume_id"))
                     + F.coalesce(F.col("_ow"), F.lit(0))).drop("_ow")
    w = Window.partitionBy("resume_id").orderBy(F.desc("role_pos"), F.desc("bullet_idx"))
    cand = F.col("bullet_idx") > 0
    rank = F.sum(F.when(cand, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum(F.when(cand, F.col("_w")).otherwise(0))
                        .over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("_rank", rank).withColumn("_before", before)
    drop = cand & ((F.col("_total") - F.col("_before")) > max_words)
    if max_drops is not None:
        drop = drop & (F.col("_rank") <= max_drops)
    return b.where(~drop).drop("_w", "_total", "_rank", "_before")


def role_positions(bullets: DataFrame, order_col: str) -> DataFrame:
    """Role position per resume on bullet rows, newest role first
    (``order_col`` desc, then role_key): a dense rank, no self-join."""
    w = Window.partitionBy("resume_id").orderBy(F.desc(order_col), F.asc("role_key"))
    return bullets.withColumn("role_pos", F.dense_rank().over(w) - 1)


def shape_resumes(bullets: DataFrame, ranks: DataFrame, summaries: DataFrame, skills: DataFrame,
                  education: DataFrame) -> DataFrame:
    """M7: T6 order, S22 skills, then the trim (W9, W7, W8). Roles are taken by ``ranks``
    (``resume_id``, ``role_key``, ``rank``: the employer's place in the profile) and
    within a rank as written, newest first; the budget counts the words of summary,
    bullets, ``skills`` (``resume_id``, ``skills`` lines) and ``education``
    (``resume_id``, ``text``). Output: ``resume_id``, ``summary``, ``skills``,
    ``bullets`` (one text, a line each) and ``n_bullets``."""
    # every table here grows with the resumes: none is broadcast
    placed = bullets.join(ranks.hint("merge"), ["resume_id", "role_key"], "left")
    w = Window.partitionBy("resume_id").orderBy(F.asc_nulls_last("rank"), F.desc("role_date"), F.asc("role_key"))
    capped = cap_bullets(placed.withColumn("role_pos", F.dense_rank().over(w) - 1))
    schooled = education.groupBy("resume_id").agg(F.sum(word_count(F.col("text"))).alias("_ew"))
    rest = (summaries.select("resume_id", summary_trim(F.col("summary")).alias("summary"))
            .join(skills.hint("merge"), "resume_id", "left").join(schooled.hint("merge"), "resume_id", "left"))
    lines = F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " | ")
    spoken = F.array_join(F.coalesce("skills", F.array().cast("array<string>")), " ")
    words = word_count(F.col("summary")) + word_count(spoken) + F.coalesce("_ew", F.lit(0))
    kept = word_budget(capped, rest.select("resume_id", words.alias("words")))
    per = kept.groupBy("resume_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("role_pos", "bullet_idx", "text"))),
                                 lambda x: x["text"]), "\n").alias("bullets"),
        F.count(F.lit(1)).alias("n"))
    return rest.join(per.hint("merge"), "resume_id", "left").select(
        "resume_id", "summary", lines.alias("skills"), F.coalesce("bullets", F.lit("")).alias("bullets"),
        F.coalesce("n", F.lit(0)).alias("n_bullets"))


def document_base(company, title, day: str) -> Column:
    """The file name of a drafted document: company, title (S25 names) and day."""
    from lantern.functions.text import safe_name
    return F.concat(safe_name(company), F.lit("_"), safe_name(title), F.lit(f"_{day}"))


def unique_names(df: DataFrame, base: Column, existing: DataFrame | None = None,
                 order: str = "ingest_seq", slice_rows: int = 100_000) -> DataFrame:
    """Names from a base; a base seen before gets -2, -3, ... in order,
    offset by how many names with that base are already stored.

    A base's rows are numbered in slices of the integer ``order`` column, each on
    its own; the rows in the base's slices before it are added from one small row
    per base and slice, so a base of any size spreads over tasks."""
    d = df.withColumn("_base", base).withColumn("_slice", F.floor(F.col(order) / slice_rows))
    sizes = d.groupBy("_base", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_base").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_base", "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    within = F.row_number().over(Window.partitionBy("_base", "_slice").orderBy(order))
    d = d.withColumn("_rank", within).join(offsets, ["_base", "_slice"]).withColumn("_n", F.col("_rank") + F.col("_offset"))
    if existing is not None:
        taken = existing.groupBy(F.col("base").alias("_base")).agg(F.count(F.lit(1)).alias("_taken"))
        d = d.join(taken, "_base", "left").withColumn("_n", F.col("_n") + F.coalesce("_taken", F.lit(0)))
    return d.withColumn("name", F.when(F.col("_n") == 1, F.col("_base"))
                        .otherwise(F.concat(F.col("_base"), F.lit("-"), F.col("_n").cast("string")))) \
        .drop("_n", "_taken", "_slice", "_offset", "_rank", "_base")


def thin_roles(bullets: DataFrame, min_highlights: int = 2) -> DataFrame:
    """Roles with fewer than ``min_highlights`` highlights (a partial /
    final count per role, then a filter)."""
    return (bullets.groupBy("resume_id", "role_key")
            .agg(F.count(F.lit(1)).alias("highlights"))
            .where(F.col("highlights") < min_highlights))


def skill_counts(skills: DataFrame, key: str = "inventory") -> DataFrame:
    """A3: per inventory, skills claimed (have_it exactly 'yes' after strip
    and lower case) and skills tracked as gaps; FAIL when none is claimed."""
    yes = F.lower(F.trim(F.coalesce(F.col("have_it"), F.lit("")))) == "yes"
    a = skills.groupBy(key).agg(F.count_if(yes).alias("claimed"),
                                (F.count(F.lit(1)) - F.count_if(yes)).alias("gaps"))
    return a.withColumn("level", F.when(F.col("claimed") > 0, "OK").otherwise("FAIL"))


def keep_prefix(highlights: DataFrame, keep: DataFrame, first_n: int = 4) -> DataFrame:
    """Per company, the highlights starting with one of its kept
    prefixes; a company with none kept keeps its first ``first_n``.

    ``highlights``: company, pos, text; ``keep``: company, prefix. A company's
    prefixes travel as one list to its highlights by one merge join, and what else
    the rule asks (the highlight kept, any of the company's kept) is read off windows
    over the same rows, so each highlight is moved once."""
    lists = keep.groupBy("company").agg(F.collect_set("prefix").alias("_keep"))
    own = F.coalesce(F.exists("_keep", lambda p: F.col("text").startswith(p)), F.lit(False))
    j = highlights.join(lists.hint("merge"), "company", "left").withColumn("_own", own).drop("_keep")
    j = j.select(*highlights.columns, F.max("_own").over(Window.partitionBy("company")).alias("_any"),
                 F.max("_own").over(Window.partitionBy("company", "pos")).alias("_hit"))
    kept = F.when(F.col("_any"), F.col("_hit") & F.col("pos").isNotNull()).otherwise(F.col("pos") < first_n)
    return j.where(kept).drop("_any", "_hit")
