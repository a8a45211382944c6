"""Skills inventory and profile operators.

An inventory (one person's skills table) is small by nature, so per-inventory
lists are ordinary ``collect_list`` aggregates sorted by the row's file order;
the sequential rules (prefix dedupe, distinct-with-caps) are array folds on
those lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HAVE_YES = ("yes", "y", "true", "1")
PER_CATEGORY = 8
INDUSTRY = "Industry Experience"
MAX_SKILL_CATEGORIES = 5
MAX_TERMS_PER_CATEGORY = 10


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def skills_table(skills: DataFrame) -> DataFrame:
    """Usable rows of an inventory (have_it yes/y/true/1, a skill name):
    certification rows apart (kind 'certification', the bare skill), the rest
    labelled 'skill (proficiency) [notes]' under their category ('Other' when
    blank). Keeps ``inventory`` and ``row_seq`` (file order)."""
    skill = _strip(F.coalesce("skill", F.lit("")))
    have = F.lower(_strip(F.coalesce("have_it", F.lit(""))))
    cat = _strip(F.coalesce("category", F.lit("Other")))
    cat = F.when(cat == "", F.lit("Other")).otherwise(cat)
    prof = _strip(F.coalesce("proficiency", F.lit("")))
    notes = _strip(F.coalesce("notes", F.lit("")))
    label = F.concat(skill, F.when(prof != "", F.concat(F.lit(" ("), prof, F.lit(")"))).otherwise(F.lit("")),
                     F.when(notes != "", F.concat(F.lit(" ["), notes, F.lit("]"))).otherwise(F.lit("")))
    is_cert = F.lower(cat).startswith("certification")
    return (skills.where((skill != "") & have.isin(*HAVE_YES))
            .select("inventory", "row_seq",
                    F.when(is_cert, "certification").otherwise("skill").alias("kind"),
                    F.when(is_cert, F.lit(None)).otherwise(cat).alias("category"),
                    F.when(is_cert, skill).otherwise(label).alias("label")))


def skills_by_category(table: DataFrame) -> DataFrame:
    """Per inventory and category, the labels in file order; categories
    ordered by first appearance (``category_pos``)."""
    s = table.where(F.col("kind") == "skill")
    g = s.groupBy("inventory", "category").agg(
        F.min("row_seq").alias("first_seq"),
        F.transform(F.array_sort(F.collect_list(F.struct("row_seq", "label"))), lambda x: x["label"])
        .alias("labels"))
    w = Window.partitionBy("inventory").orderBy("first_seq")
    return g.withColumn("category_pos", F.row_number().over(w))


def ordered_distinct_union(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``first``'s values then ``second``'s, each in its ``seq`` order,
    exact duplicates dropped keeping the first (``dict.fromkeys(a + b)``)."""
    both = (first.select(key, F.lit(0).alias("_src"), "seq", F.col(value).alias("v"))
            .unionByName(second.select(key, F.lit(1).alias("_src"), "seq", F.col(value).alias("v"))))
    return (both.groupBy(key).agg(F.array_distinct(F.transform(
        F.array_sort(F.collect_list(F.struct("_src", "seq", "v"))), lambda x: x["v"])).alias("values")))


def profile_skills(table: DataFrame, profile_certs: DataFrame, inventories: DataFrame) -> DataFrame:
    """Per profile (inventory): when the table has usable rows its skills
    replace the profile's, and the certifications become the table's followed
    by the profile's, distinct, order kept; otherwise the profile stays."""
    has = table.groupBy("inventory").agg(F.count_if(F.col("kind") == "skill").alias("n_skills"),
                                         F.count_if(F.col("kind") == "certification").alias("n_certs"))
    table_certs = table.where(F.col("kind") == "certification").select(
        "inventory", F.col("row_seq").alias("seq"), F.col("label").alias("cert"))
    merged = ordered_distinct_union(table_certs, profile_certs.select("inventory", "seq", "cert"),
                                    "inventory", "cert")
    own = profile_certs.groupBy("inventory").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "cert"))), lambda x: x["cert"]).alias("own"))
    cats = skills_by_category(table).groupBy("inventory").agg(F.count(F.lit(1)).alias("n_categories"))
    j = (inventories.join(has, "inventory", "left").join(merged, "inventory", "left")
         .join(own, "inventory", "left").join(cats, "inventory", "left"))
    use_table = (F.coalesce("n_skills", F.lit(0)) + F.coalesce("n_certs", F.lit(0))) > 0
    certs = F.when(use_table & (F.coalesce("n_certs", F.lit(0)) > 0), F.col("values")) \
        .otherwise(F.coalesce("own", F.array().cast("array<string>")))
    return j.select("inventory", F.when(use_table, "table").otherwise("profile").alias("skills_source"),
                    F.when(use_table, F.coalesce("n_categories", F.lit(0))).otherwise(F.lit(0)).cast("long")
                    .alias("n_categories"),
                    F.array_join(certs, " | ").alias("certifications"))


def short_skills(skills: DataFrame) -> DataFrame:
    """The general resume's form: have_it exactly 'yes', certifications
    out, the name cut at ' (' and at ':'; category kept as written."""
    have = F.lower(_strip(F.coalesce("have_it", F.lit(""))))
    cat = _strip(F.coalesce("category", F.lit("")))
    skill = _strip(F.coalesce("skill", F.lit("")))
    short = _strip(F.split_part(F.split_part(skill, F.lit(" ("), F.lit(1)), F.lit(":"), F.lit(1)))
    return (skills.where((have == "yes") & (skill != "") & ~F.lower(cat).startswith("certification"))
            .select("inventory", "row_seq", cat.alias("category"), short.alias("skill")))


def prefix_dedupe(items: Column) -> Column:
    """Keep an item unless its key (lower case, trailing 's' removed) is
    a prefix of, or starts with, a key already kept: one array fold."""
    zero = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc, s):
        k = F.regexp_replace(F.lower(s), "s+$", "")
        clash = F.exists(acc["seen"], lambda p: k.startswith(p) | p.startswith(k))
        return F.when(clash, acc).otherwise(F.struct(F.array_append(acc["seen"], k).alias("seen"),
                                                     F.array_append(acc["out"], s).alias("out")))
    return F.aggregate(items, zero, step)["out"]


def skill_lines(short: DataFrame, order: list[str], per_category: int = PER_CATEGORY) -> DataFrame:
    """Per inventory, one line per category of ``order`` that has skills
    (prefix-deduplicated, at most ``per_category``), then the industry line
    with every industry; ``line_pos`` gives the order."""
    g = short.groupBy("inventory", "category").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("row_seq", "skill"))), lambda x: x["skill"]).alias("items"))
    pos = F.coalesce(*[F.when(F.col("category") == c, F.lit(i)) for i, c in enumerate(order)])
    cats = (g.where(pos.isNotNull())
            .select("inventory", pos.alias("line_pos"),
                    F.concat(F.col("category"), F.lit(": "),
                             F.array_join(F.slice(prefix_dedupe(F.col("items")), 1, per_category), ", "))
                    .alias("line")))
    ind = (g.where(F.col("category") == INDUSTRY)
           .select("inventory", F.lit(len(order)).alias("line_pos"),
                   F.concat(F.lit(INDUSTRY + ": "), F.array_join("items", ", ")).alias("line")))
    return cats.unionByName(ind)


def normalize_skills(skills: Column, max_categories: int = MAX_SKILL_CATEGORIES,
                     max_terms: int = MAX_TERMS_PER_CATEGORY) -> Column:
    """A resume's skills lines -> 'Category: term, term' lines of atomic
    terms. Parentheses become siblings. Only when there are >= 3 entries and
    every one is a category line is it read as categories: the first
    ``max_categories``, terms stripped of ' .;', each term kept once across
    categories (case-blind) and at most ``max_terms`` per category (a term
    past the cap is not looked at, so it is not marked seen). Otherwise the
    list is de-duplicated case-blind, order kept."""
    cat_line = "^([^:]{3,40}):\\s*(.+)$"
    s = F.transform(F.coalesce(skills, F.array().cast("array<string>")),
                    lambda x: _strip(F.regexp_replace(x, "\\s*\\(([^)]*)\\)", ", $1")))
    categorised = (F.size(s) >= 3) & F.forall(s, lambda x: x.rlike(cat_line))
    # flat: first spelling of each lower-cased non-empty entry
    flat0 = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))
    flat = F.aggregate(s, flat0, lambda acc, x: F.when(
        F.array_contains(acc["seen"], F.lower(x)) | (x == ""), acc).otherwise(
        F.struct(F.array_append(acc["seen"], F.lower(x)).alias("seen"),
                 F.array_append(acc["out"], x).alias("out"))))["out"]
    cats = F.transform(F.slice(s, 1, max_categories), lambda x: F.struct(
        _strip(F.regexp_extract(x, cat_line, 1)).alias("label"),
        F.filter(F.transform(F.split(F.regexp_extract(x, cat_line, 2), ","),
                             lambda t: F.regexp_replace(t, "^[ .;]+|[ .;]+$", "")), lambda t: t != "")
        .alias("terms")))

    def per_cat(acc, c):
        def add(st, t):
            k = F.lower(t)
            full = F.size(st["keep"]) >= max_terms
            skip = full | F.array_contains(st["seen"], k)
            return F.when(skip, st).otherwise(F.struct(F.array_append(st["seen"], k).alias("seen"),
                                                       F.array_append(st["keep"], t).alias("keep")))
        inner = F.aggregate(c["terms"], F.struct(acc["seen"].alias("seen"),
                                                 F.array().cast("array<string>").alias("keep")), add)
        line = F.concat(c["label"], F.lit(": "), F.array_join(inner["keep"], ", "))
        return F.struct(inner["seen"].alias("seen"),
                        F.when(F.size(inner["keep"]) > 0, F.array_append(acc["out"], line))
                        .otherwise(acc["out"]).alias("out"))
    cleaned = F.aggregate(cats, flat0, per_cat)["out"]
    return F.when(F.size(s) == 0, F.coalesce(skills, F.array().cast("array<string>"))) \
        .when(categorised, cleaned).otherwise(flat)
