"""Master record: Markdown lines -> tables and back (R21, W6, K5, A5, A6, S28,
J10, T4).

The line-by-line state machine of the record format becomes window columns
over ``(doc_id, line_no)``: the section a line is in is the last section
heading at or before it; a role is open while its heading is later than the
last section heading; an accomplishment (or the recorded-bullets block) is
open while its heading is later than the role heading. Each of these is a
running max / last-non-null over one window partitioned by document, so a
corpus of records spreads by document and no line is looked at twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lantern.functions.predicates import bound, in_order_once
from lantern.sources.packed import whole_files

# The record format.
EVIDENCE_TIERS = ("metric", "derived", "scope", "qualitative")
ROLE_FIELDS = ("Dates", "Location", "Company", "Challenge", "Authority",
               "Territory", "Budget", "Reported to", "Markets",
               "Responsibilities", "Recognition", "Note on accomplishments")
ACC_FIELDS = ("Problem", "Actions", "Results", "Evidence")
BULLETS_HEADING = "Recorded resume bullets"
BULLETS_PREAMBLE = [
    "From a finished resume, so each one is already compressed: the problem it",
    "solved and the actions taken are missing. Expanding one into its own",
    "`####` block is optional -- they are usable as they stand.",
]
ROLE_HEADING = r"(?U)^###\s+(.+?)\s+(?:—|--|-)\s+(.+?)\s*$"
ACC_HEADING = r"(?U)^####\s+(.+?)\s*$"
LABELLED = r"(?U)^-\s+\*\*([^:*]+):\*\*\s*(.*)$"
PLAIN_BULLET = r"(?U)^-\s+(?!\*\*)(.+)$"
SECTION = r"(?U)^##\s+(.+?)\s*$"
SUBSECTION = r"(?U)^###\s+(.+?)\s*$"
FILL_IN = r"(?i)^\[FILL IN"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def _blank_to_empty(c: Column) -> Column:
    return F.when(c.rlike(FILL_IN), F.lit("")).otherwise(c)


def read_record_lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Record files -> (doc_id, line_no, line). A record file is one
    person's document (small), so each is read whole and split by lines; in
    folders ``doc_id=...`` the id is the folder's, else it is the file's path.
    ``packed``: the files lie in a packed folder."""
    if packed:
        raw = whole_files(spark, path, "*", packed).withColumn("value", F.col("content").cast("string"))
        doc = F.regexp_replace("path", "^.*?(?:^|/)doc_id=([^/]*)/.*$", "$1")
    else:
        raw = spark.read.text(path, wholetext=True)
        doc = F.col("doc_id") if "doc_id" in raw.columns else F.col("_metadata.file_path")
    return raw.select(doc.alias("doc_id"), F.posexplode(F.split(F.regexp_replace("value", "\n\\z", ""), "\n")).alias("line_no", "line"))


def classify_lines(lines: DataFrame) -> DataFrame:
    """W6 core: every line with the state it is read in.

    Adds: ``where`` (header/contact/positioning/roles/trailing), ``sub``
    (competencies/sets_apart inside positioning), ``role_line`` (line_no of
    the open role's heading, null when none), ``acc_line`` / ``in_bullets``
    (the open accomplishment heading, or the bullets block), and the line's
    own kind and captured groups.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    line, empty = F.col("line"), F.lit("")
    starts = line.startswith
    # a heading's or label's capture is never empty, so one extraction also tells whether
    # the line matches; a look at its first characters spares most lines the pattern
    found = lambda may, pattern, group=1: F.when(may, F.regexp_extract("line", pattern, group)).otherwise(empty)
    d = (lines.withColumn("line", F.coalesce(line, empty))
         .withColumn("line", F.when(F.substring("line", -1, 1).rlike("(?U)\\s"), F.regexp_replace("line", "(?U)\\s+$", "")).otherwise(line))
         .withColumn("_sec", found(starts("##") & ~starts("###"), SECTION)))
    sec_name = F.lower(_strip(F.col("_sec")))
    d = d.withColumn("_is_section", F.col("_sec") != "").withColumn("_sec_name", F.when(F.col("_is_section"), sec_name))
    named = F.col("_sec_name")
    d = d.withColumn("_sec_kind", F.when(F.col("_is_section"), F.when(named.isin("contact", "positioning", "roles"), named)
                                         .otherwise("trailing")))
    d = d.select(*lines.columns, "_is_section", "_sec_kind",
                 F.coalesce(F.last("_sec_kind", ignorenulls=True).over(w), F.lit("header")).alias("where"),
                 F.max(F.when(F.col("_is_section"), F.col("line_no"))).over(w).alias("_last_sec"))
    after_sec = lambda c: c.isNotNull() & (F.col("_last_sec").isNull() | (c > F.col("_last_sec")))

    # positioning subsections, and roles
    inside = lambda where: (F.col("where") == where) & ~F.col("_is_section") & starts("###")
    d = d.withColumn("_sub", found(inside("positioning"), SUBSECTION)).withColumn("_role", found(inside("roles"), ROLE_HEADING))
    d = (d.withColumn("_is_sub", F.col("_sub") != "").withColumn("_is_role", F.col("_role") != "")
         .withColumn("_kind_of_sub", F.when(F.col("_is_sub"), F.when(
             F.lower(_strip(F.col("_sub"))).contains("competenc"), "competencies").otherwise("sets_apart")))
         .drop("_sub"))
    d = d.select("*", F.max(F.when(F.col("_is_sub"), F.col("line_no"))).over(w).alias("_sub_line"),
                 F.last("_kind_of_sub", ignorenulls=True).over(w).alias("_sub_kind"),
                 F.max(F.when(F.col("_is_role"), F.col("line_no"))).over(w).alias("_role_line"))
    in_roles = (F.col("where") == "roles") & ~F.col("_is_section")
    d = (d.withColumn("sub", F.when(after_sec(F.col("_sub_line")), F.col("_sub_kind")))
         .withColumn("role_line", F.when(in_roles & after_sec(F.col("_role_line")), F.col("_role_line"))))

    # accomplishments
    open_role = F.col("role_line").isNotNull()
    d = d.withColumn("_acc", found(open_role & ~F.col("_is_role") & starts("####"), ACC_HEADING))
    d = (d.withColumn("_is_acc", F.col("_acc") != "").withColumn("_acc", _strip(F.col("_acc")))
         .withColumn("_is_bul", F.when(F.col("_is_acc"), F.lower("_acc") == BULLETS_HEADING.lower())))
    d = d.select("*", F.max(F.when(F.col("_is_acc"), F.col("line_no"))).over(w).alias("_acc_line"),
                 F.last("_is_bul", ignorenulls=True).over(w).alias("_acc_bul"))
    acc_open = open_role & F.col("_acc_line").isNotNull() & (F.col("_acc_line") > F.col("role_line"))
    d = (d.withColumn("in_bullets", acc_open & F.col("_acc_bul"))
         .withColumn("acc_line", F.when(acc_open & ~F.col("_acc_bul"), F.col("_acc_line"))))

    # the line's own kind, in the order the format tests them; each step reads columns of
    # the step before, so that no pattern is tried twice
    def own_kind(raw):
        lab = raw != ""
        kind = (F.when(F.col("_is_section"), F.when(F.col("_sec_kind") == "trailing", "trailing").otherwise("section"))
                .when(F.col("where") == "trailing", "trailing")
                .when(F.col("where") == "header", "header")
                .when(F.col("where") == "contact", F.when(lab, "contact"))
                .when(F.col("where") == "positioning",
                      F.when(F.col("_is_sub"), "subsection")
                      .when((F.col("sub") == "competencies") & starts("-") & line.rlike(PLAIN_BULLET), "competency")
                      .when((F.col("sub") == "sets_apart") & (_strip(line) != ""), "sets_apart"))
                .when(F.col("_is_role"), "role")
                .when(~open_role, F.lit(None))
                .when(F.col("_is_acc"), F.when(F.col("_is_bul"), "bullets_heading").otherwise("accomplishment"))
                .when(lab, F.when(F.col("acc_line").isNotNull() & _strip(raw).isin(*ACC_FIELDS), "acc_field")
                      .otherwise("role_field"))
                .when(starts(">"), "note")
                .when(F.col("in_bullets") & starts("-") & line.rlike(PLAIN_BULLET), "bullet"))
        return F.struct(raw.alias("_raw"), kind.alias("kind"))

    # generated rows: a filter on the kind stays above them instead of repeating its tests
    d = d.select("*", F.inline(F.transform(F.array(found(starts("-"), LABELLED)), own_kind)))
    kind = F.col("kind")
    labelled = kind.isin("contact", "acc_field", "role_field")
    value = _strip(F.regexp_extract("line", LABELLED, 2))
    text = (F.when(kind == "role", F.lit(None))
            .when(kind.isin("accomplishment", "bullets_heading"), F.col("_acc"))
            .when(kind == "contact", value)
            .when(labelled, bound(value, _blank_to_empty))
            .when(kind == "note", F.regexp_replace(F.regexp_replace("line", "^[> ]+", ""), "(?U)\\s+$", ""))
            .when(kind.isin("competency", "bullet"), _strip(F.regexp_extract("line", PLAIN_BULLET, 1)))
            .when(kind == "sets_apart", _strip(line))
            .otherwise(line))
    return d.select("doc_id", "line_no", "line", "where", "sub", "role_line", "acc_line", "in_bullets", "kind",
                    F.when(labelled, _strip(F.col("_raw"))).alias("label"), text.alias("text"),
                    F.when(kind == "role", _strip(F.col("_role"))).alias("employer"),
                    F.when(kind == "role", _strip(F.regexp_extract("line", ROLE_HEADING, 2))).alias("title"))


def parse_record(lines: DataFrame) -> DataFrame:
    """The parsed items in long form: one row per kept piece, with its
    role and accomplishment (by heading line) and its position.
    kinds: header, contact, competency, sets_apart, role, role_field,
    note, accomplishment, acc_field, bullet, trailing."""
    c = classify_lines(lines)
    keep = c.where(F.col("kind").isNotNull() & (F.col("kind") != "section")
                   & (F.col("kind") != "subsection") & (F.col("kind") != "bullets_heading"))
    return keep.select("doc_id", "line_no", "kind", "role_line", "acc_line", "label", "text",
                       "employer", "title")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """W6 rejects: lines inside a role the format has no place for (wrapped
    continuation lines, stray text), so the loss is visible."""
    c = classify_lines(lines)
    return c.where((F.col("where") == "roles") & F.col("kind").isNull() & (_strip(F.col("line")) != ""))


# --- tables from the parsed items --------------------------------------------

def roles_table(items: DataFrame) -> DataFrame:
    return items.where(F.col("kind") == "role").select(
        "doc_id", F.col("line_no").alias("role_line"), "employer", "title")


def accomplishments_table(items: DataFrame) -> DataFrame:
    """One row per accomplishment with its four fields (last value wins)."""
    accs = items.where(F.col("kind") == "accomplishment").select(
        "doc_id", "role_line", F.col("line_no").alias("acc_line"), F.col("text").alias("acc_title"))
    f = (items.where(F.col("kind") == "acc_field")
         .groupBy("doc_id", "acc_line")
         .agg(*[F.max_by(F.when(F.col("label") == lb, F.col("text")),
                         F.when(F.col("label") == lb, F.col("line_no"))).alias(lb.lower()) for lb in ACC_FIELDS]))
    return accs.join(f, ["doc_id", "acc_line"], "left").select(
        "doc_id", "role_line", "acc_line", "acc_title",
        *[F.coalesce(F.col(lb.lower()), F.lit("")).alias(lb.lower()) for lb in ACC_FIELDS])


def role_coverage(items: DataFrame) -> DataFrame:
    """A5: per role, accomplishments (non-empty), quantified ones (evidence
    metric/derived, or a digit in the results), recorded bullets, total.

    One pass over the items: first per accomplishment (last value of each field), then
    per role. Items lie by document, so neither step moves a row."""
    kind = F.col("kind")
    role = F.when(kind == "role", F.col("line_no")).otherwise(F.col("role_line"))
    acc = F.when(kind == "accomplishment", F.col("line_no")).when(kind == "acc_field", F.col("acc_line"))
    named = lambda lb: (kind == "acc_field") & (F.col("label") == lb)
    per_acc = (items.where(kind.isin("role", "accomplishment", "acc_field", "bullet"))
               .groupBy("doc_id", role.alias("role_line"), acc.alias("acc"))
               .agg(F.max(F.when(kind == "role", F.struct("employer", "title"))).alias("head"),
                    F.max(F.when(kind == "accomplishment", F.coalesce("text", F.lit("")))).alias("acc_title"),
                    F.count_if(kind == "bullet").alias("bullets"),
                    *[F.coalesce(F.max_by(F.when(named(lb), F.col("text")), F.when(named(lb), F.col("line_no"))), F.lit(""))
                      .alias(lb.lower()) for lb in ACC_FIELDS]))
    non_empty = F.col("acc_title").isNotNull() & (
        (F.col("acc_title") != "") | (F.col("problem") != "") | (F.col("actions") != "") | (F.col("results") != ""))
    quant = F.col("evidence").isin("metric", "derived") | F.col("results").rlike("(?U)\\d")
    out = (per_acc.groupBy("doc_id", "role_line")
           .agg(F.max("head").alias("head"), F.count_if(non_empty).alias("accomplishments"),
                F.count_if(non_empty & quant).alias("quantified"), F.sum("bullets").cast("long").alias("bullets"))
           .where(F.col("head").isNotNull()))
    return out.select("doc_id", "role_line", "head.employer", "head.title", "accomplishments", "quantified", "bullets",
                      (F.col("accomplishments") + F.col("bullets")).alias("total"))


def record_coverage(coverage: DataFrame) -> DataFrame:
    """Totals per record across its roles."""
    return coverage.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("roles"),
        *[F.sum(c).cast("long").alias(c) for c in ("accomplishments", "quantified", "bullets", "total")])


def thinnest_first(coverage: DataFrame) -> DataFrame:
    """A6 order: within each record, roles with the least recorded first
    (total, then quantified; record order on ties) as ``need_rank``."""
    w = Window.partitionBy("doc_id").orderBy("total", "quantified", "role_line")
    return coverage.withColumn("need_rank", F.row_number().over(w))


def coverage_note(target: int = 10, prompt: bool = False) -> Column:
    """One line on where a role stands (from A5 columns)."""
    parts = F.concat_ws(", ", F.concat(F.col("total").cast("string"), F.lit(" recorded")),
                        F.when(F.col("bullets") > 0, F.concat(F.col("bullets").cast("string"),
                                                              F.lit(" from a resume only"))),
                        F.concat(F.col("quantified").cast("string"), F.lit(" with a number")))
    if prompt:
        parts = F.when(F.col("total") < target, F.concat(
            parts, F.lit(f" — most people reach about {target} for a role once they look"))).otherwise(parts)
        empty = F.lit("nothing recorded yet — a good role usually has plenty once you start looking")
    else:
        empty = F.lit("nothing recorded yet")
    return F.when(F.col("total") == 0, empty).otherwise(parts)


def squash(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def role_lookup(roles: DataFrame, wanted: DataFrame, employer: str = "employer") -> DataFrame:
    """The first role (heading order) whose employer equals the wanted
    one ignoring case and punctuation: an equi-join on the squashed name."""
    r = roles.withColumn("_k", squash(F.col("employer")))
    wnt = wanted.withColumn("_k", squash(F.col(employer)))
    j = wnt.join(r.select("doc_id", "_k", "role_line", F.col("employer").alias("role_employer"),
                          F.col("title").alias("role_title")), ["doc_id", "_k"])
    keys = [c for c in wanted.columns]
    return (j.groupBy(*keys)
            .agg(F.min_by(F.struct("role_line", "role_employer", "role_title"), "role_line").alias("m"))
            .select(*keys, "m.role_line", "m.role_employer", "m.role_title"))


# Interview lenses: name, keyword stems, and the question asked.
LENSES = [
    ("people", ("hire", "hired", "train", "coach", "mentor", "team", "staff",
                "promot", "recruit"),
     "Who did you hire, train or promote there, and what changed because of it?"),
    ("fixing", ("broken", "fixed", "mess", "cleaned", "rescued", "failing",
                "backlog", "inherit"),
     "What was broken or neglected when you arrived that you ended up fixing?"),
    ("money", ("cost", "saved", "revenue", "budget", "margin", "profit",
               "spend", "price"),
     "Did anything you did make or save the organisation money, even indirectly?"),
    ("speed", ("faster", "hours", "days", "automat", "manual", "time",
               "turnaround", "delay"),
     "What used to take a long time, or take a lot of hands, that stopped doing so?"),
    ("risk", ("audit", "complian", "outage", "safety", "error", "fraud",
              "risk", "incident", "quality"),
     "Did you prevent something going wrong, or catch something that had?"),
    ("legacy", ("standard", "adopted", "documented", "still", "rolled out",
                "template", "process", "handbook"),
     "Is anything you built or wrote there still in use after you left?"),
    ("stopping", ("stopped", "retired", "simplif", "consolidat", "removed",
                  "cancelled", "declined"),
     "Did you stop, simplify or retire something that was not worth doing?"),
]


def _count_occ(text: Column, key: str) -> Column:
    """Non-overlapping occurrences of ``key`` in ``text`` (``str.count``)."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(key), F.lit("")))) / len(key)).cast("long")


def pick_lens(role_text: DataFrame) -> DataFrame:
    """T4: per role, the lens whose keywords occur least often in what the
    role already records (list order on ties). ``role_text`` has doc_id,
    role_line and the lower-cased recorded text ``text``."""
    scores = F.array(*[F.struct(
        sum((_count_occ(F.col("text"), k) for k in keys), F.lit(0)).alias("n"),
        F.lit(i).alias("i"), F.lit(name).alias("lens"), F.lit(question).alias("question"))
        for i, (name, keys, question) in enumerate(LENSES)])
    best = F.array_min(scores)
    return role_text.select("doc_id", "role_line", best["lens"].alias("lens"), best["question"].alias("question"),
                            best["n"].alias("hits"))


def role_text(items: DataFrame) -> DataFrame:
    """The text a lens is counted over: accomplishment title, problem, actions
    and results, then recorded bullets, lower-cased and space-joined.

    One pass over the items, as in ``role_coverage``: per accomplishment (last value of each
    field) or bullet, then per role. Items lie by document, so neither step moves a row."""
    kind = F.col("kind")
    role = F.when(kind == "role", F.col("line_no")).otherwise(F.col("role_line"))
    pos = F.when(kind.isin("accomplishment", "bullet"), F.col("line_no")).when(kind == "acc_field", F.col("acc_line"))
    named = lambda lb: (kind == "acc_field") & (F.col("label") == lb)
    value = lambda lb: F.coalesce(F.max_by(F.when(named(lb), F.col("text")), F.when(named(lb), F.col("line_no"))), F.lit(""))
    per = (items.where(kind.isin("role", "accomplishment", "acc_field", "bullet"))
           .groupBy("doc_id", role.alias("role_line"), pos.alias("pos"))
           .agg(F.count_if(kind == "role").alias("heads"),
                F.max(F.when(kind.isin("accomplishment", "bullet"), F.struct(
                    (kind == "bullet").cast("int").alias("grp"), F.coalesce("text", F.lit("")).alias("t")))).alias("own"),
                *[value(lb).alias(lb.lower()) for lb in ACC_FIELDS[:3]]))
    whole = F.when(F.col("own.grp") == 0, F.concat_ws(" ", "own.t", "problem", "actions", "results")).otherwise(F.col("own.t"))
    out = per.groupBy("doc_id", "role_line").agg(
        F.sum("heads").alias("heads"),
        F.array_sort(F.collect_list(F.when(F.col("own").isNotNull(), F.struct(F.col("own.grp").alias("grp"), "pos", whole.alias("t")))))
        .alias("parts"))
    return out.where(F.col("heads") > 0).select(
        "doc_id", "role_line", F.when(F.col("doc_id").isNull(), "").otherwise(  # a record without an id owns nothing
            F.lower(F.array_join(F.transform("parts", lambda s: s["t"]), " "))).alias("text"))


# --- K5 render ----------------------------------------------------------------

def render_record(items: DataFrame) -> DataFrame:
    """K5: parsed items -> one Markdown text per record, in the format's fixed
    order: header (trailing blanks dropped), contact, positioning, roles with
    their fields (format order, then the rest), notes, accomplishments
    ('[FILL IN]' for blank fields, evidence left out when blank), recorded
    bullets, then the trailing sections.

    Every output line gets a sort key (k1..k4). Item rows emit their own lines
    together with the fixed lines of the block they open (a section header, a
    role heading, the bullets preamble); the copies those fixed lines get from
    several items are identical structs and are dropped by one
    ``array_distinct`` per document. Four inputs in all: the items, and the
    last-value-wins tables of contact labels, role fields and accomplishments.
    """
    I = items  # noqa: E741
    z = F.lit(0).cast("long")

    def ln(k1, k2, k3, k4, out):
        return F.struct(F.lit(k1).cast("long").alias("k1"), k2.cast("long").alias("k2"),
                        k3.cast("long").alias("k3"), k4.cast("long").alias("k4"), out.alias("out"))

    def lit(v):
        return F.lit(v).cast("long")

    kind, lno, rl = F.col("kind"), F.col("line_no").cast("long"), F.col("role_line").cast("long")
    roles_hdr = [ln(4, lit(-10), z, z, F.lit("")), ln(4, lit(-9), z, z, F.lit("## Roles"))]
    bl_hdr = lambda role: [ln(4, role, lit(9 * 100000000), lit(j), F.lit(t))
                           for j, t in enumerate(["", f"#### {BULLETS_HEADING}", ""] + BULLETS_PREAMBLE + [""])]
    lines = (
        F.when(kind == "header", F.array(ln(0, lno, z, z, F.col("text"))))
        .when(kind == "competency", F.array(
            ln(2, lit(-10), z, z, F.lit("")), ln(2, lit(-9), z, z, F.lit("## Positioning")),
            ln(2, lit(-5), z, z, F.lit("")), ln(2, lit(-4), z, z, F.lit("### Core competencies")),
            ln(2, lit(-3), z, z, F.lit("")), ln(2, lno, z, z, F.concat(F.lit("- "), F.col("text")))))
        .when(kind == "sets_apart", F.array(
            ln(2, lit(-10), z, z, F.lit("")), ln(2, lit(-9), z, z, F.lit("## Positioning")),
            ln(3, lit(-5), z, z, F.lit("")), ln(3, lit(-4), z, z, F.lit("### What sets me apart")),
            ln(3, lit(-3), z, z, F.lit("")), ln(3, lno, z, z, F.col("text"))))
        .when(kind == "role", F.array(
              ln(4, lno, z, lit(0), F.lit("")),
              ln(4, lno, z, lit(1), F.concat(F.lit("### "), F.col("employer"), F.lit(" — "), F.col("title"))),
              ln(4, lno, z, lit(2), F.lit(""))))
        .when(kind == "note", F.array(ln(4, rl, lit(2), lit(-1), F.lit("")),
                                      ln(4, rl, lit(2), lno, F.concat(F.lit("> "), F.col("text")))))
        .when(kind == "bullet", F.array(ln(4, rl, lit(9 * 100000000), F.lit(100) + lno, F.concat(F.lit("- "), F.col("text")))))
        .when(kind == "trailing", F.array(ln(5, lno, z, z, F.col("text"))))
    )
    # every document has the roles heading; a role with bullets has their heading once
    main = I.select("doc_id", lines.alias("ls"), F.when(kind == "bullet", F.struct(rl.alias("at"))).alias("bl"))

    contact = (I.where(kind == "contact").groupBy("doc_id", "label")
               .agg(F.min("line_no").alias("pos"), F.max_by("text", "line_no").alias("v")))
    c_lines = contact.select("doc_id", F.array(
        ln(1, lit(-3), z, z, F.lit("")), ln(1, lit(-2), z, z, F.lit("## Contact")), ln(1, lit(-1), z, z, F.lit("")),
        ln(1, F.col("pos"), z, z, F.concat(F.lit("- **"), F.col("label"), F.lit(":** "), F.col("v")))).alias("ls"))

    fields = (I.where(kind == "role_field").groupBy("doc_id", "role_line", "label")
              .agg(F.min("line_no").alias("pos"), F.max_by("text", "line_no").alias("v"))
              .where(F.col("v") != ""))
    order = F.coalesce(*[F.when(F.col("label") == lb, F.lit(i)) for i, lb in enumerate(ROLE_FIELDS)],
                       F.lit(100))
    f_lines = fields.select("doc_id", F.array(ln(4, rl, lit(1), order * 1000000 + F.col("pos"), F.concat(
        F.lit("- **"), F.col("label"), F.lit(":** "), F.col("v")))).alias("ls"))

    accs = accomplishments_table(I)
    al = F.lit(3) * 100000000 + F.col("acc_line")
    heading = F.concat(F.lit("#### "), F.when(F.col("acc_title") != "", F.col("acc_title"))
                       .otherwise(F.lit("[FILL IN: short title]")))
    acc_ls = [ln(4, rl, al, lit(0), F.lit("")), ln(4, rl, al, lit(1), heading), ln(4, rl, al, lit(2), F.lit(""))]
    for j, lb in enumerate(ACC_FIELDS):
        v = F.col(lb.lower())
        line = ln(4, rl, al, lit(10 + j), F.concat(F.lit(f"- **{lb}:** "),
                                                   F.when(v != "", v).otherwise(F.lit("[FILL IN]"))))
        acc_ls.append(F.when(v != "", line) if lb == "Evidence" else line)
    a_lines = accs.select("doc_id", F.array_compact(F.array(*acc_ls)).alias("ls"))

    allrows = main.unionByName(c_lines, True).unionByName(f_lines, True).unionByName(a_lines, True)
    per_doc = allrows.groupBy("doc_id").agg(F.flatten(F.collect_list("ls")).alias("_l"), F.collect_set("bl").alias("_bl"))
    all_lines = F.concat("_l", F.array(*roles_hdr), F.flatten(F.transform("_bl", lambda r: F.array(*bl_hdr(r["at"])))))
    # header: blank lines after its last non-blank line are dropped; trailing
    # part: blank lines before its first non-blank line are dropped
    nonblank = lambda x: F.regexp_replace(x["out"], "(?U)\\s", "") != ""
    h_last = F.array_max(F.transform(F.filter("_l", lambda x: (x["k1"] == 0) & nonblank(x)), lambda x: x["k2"]))
    t_first = F.array_min(F.transform(F.filter("_l", lambda x: (x["k1"] == 5) & nonblank(x)), lambda x: x["k2"]))
    # found once per document, not for each line
    kept = bound(F.struct(h_last.alias("h"), t_first.alias("t")), lambda ends: F.concat(
        F.filter(all_lines, lambda x: ((x["k1"] != 0) | (x["k2"] <= F.coalesce(ends["h"], F.lit(-1))))
                 & ((x["k1"] != 5) | (x["k2"] >= F.coalesce(ends["t"], F.lit(1 << 62))))),
        F.when(ends["t"].isNotNull(), F.array(ln(5, lit(-1), z, z, F.lit("")))).otherwise(F.array().cast("array<struct<k1:bigint,k2:bigint,k3:bigint,k4:bigint,out:string>>"))))
    ordered = F.transform(in_order_once(kept), lambda x: x["out"])
    # trailing blank lines are dropped (the last non-blank line keeps its own
    # trailing spaces), then one newline ends the text
    body = F.regexp_replace(F.array_join(ordered, "\n"), "(?U)(\n\\s*)+$", "")
    return per_doc.select("doc_id", F.concat(body, F.lit("\n")).alias("markdown"))
