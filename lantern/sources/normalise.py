"""Normalisers: landed payloads / messages -> the posting shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.functions import text as X
from lantern.operators.filters import sender_filter

POSTING_COLS = ["source", "company", "title", "location", "url", "description_html", "posting_id"]


def email_postings(messages: DataFrame, include_senders=None, exclude_senders=None,
                   candidate_name: str | None = None, max_chars: int | None = None,
                   applications: DataFrame | None = None) -> DataFrame:
    """Messages -> postings. P10 sender lists, empty messages out, reply
    subjects (P11, P12) skipped, weak reply signals that tie to an application
    skipped (P24, when ``applications`` is given), then S8 subject parse, S9
    board link, body cut to ``max_chars``, id = first 12 hex of sha1(message
    id, else subject+sender)."""
    m = sender_filter(messages, include_senders, exclude_senders)
    m = m.where((F.coalesce("subject", F.lit("")) != "") | (F.coalesce("body", F.lit("")) != ""))
    reply = X.application_subject("subject") | X.candidate_name_subject("subject", candidate_name)
    m = m.where(~reply)
    if applications is not None:
        from lantern.operators.link import reply_like_drops
        m = m.join(reply_like_drops(m, applications).select("msg_id"), "msg_id", "left_anti")
    company, title = X.alert_subject("subject", "sender")
    mid = F.col("msg_id").cast("string")
    subject = F.coalesce("subject", F.lit(""))
    sender = F.coalesce("sender", F.lit(""))
    body = F.coalesce("body", F.lit(""))
    body = body if max_chars is None else F.substring(body, 1, max_chars)
    return m.select(
        F.lit("email").alias("source"), company.alias("company"), title.alias("title"),
        F.lit("").alias("location"), X.board_link("body", F.col("msg_id")).alias("url"),
        F.concat(F.lit("From: "), sender, F.lit("\nSubject: "), subject, F.lit("\n\n"),
                 body).alias("description_html"),
        X.content_hash(F.coalesce(mid, F.concat(subject, sender))).alias("posting_id"),
        F.col("msg_id").alias("ingest_seq"))


# ---------------------------------------------------------------------------
# Board payloads (R1-R4, R9). Each raw row is one landed response: the board
# name and the response body parsed with a fixed schema (PERMISSIVE, so a bad
# file lands in ``_corrupt_record`` instead of failing the read).
# ---------------------------------------------------------------------------

GREENHOUSE_SCHEMA = ("board string, jobs array<struct<id:bigint, title:string, location:struct<name:string>,"
                     " absolute_url:string, content:string>>, _corrupt_record string")
LEVER_SCHEMA = ("board string, postings array<struct<id:string, text:string, categories:struct<location:string>,"
                " hostedUrl:string, descriptionPlain:string, description:string>>, _corrupt_record string")
WORKDAY_SCHEMA = ("tenant string, host string, site string, jobPostings array<struct<title:string,"
                  " locationsText:string, externalPath:string, bulletFields:array<string>>>,"
                  " _corrupt_record string")
ASHBY_SCHEMA = ("board string, jobs array<struct<id:string, title:string, location:string, jobUrl:string,"
                " descriptionHtml:string>>, _corrupt_record string")
REMOTIVE_SCHEMA = ("jobs array<struct<id:bigint, title:string, company_name:string,"
                   " candidate_required_location:string, url:string, description:string>>,"
                   " _corrupt_record string")


def read_payloads(spark, path: str, schema: str):
    """Landed JSON responses (one per line) with a fixed schema; malformed
    files become reject rows rather than failing the job."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def rejects(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_corrupt_record").isNotNull())


def _post(source, company, title, location, url, desc, pid) -> list:
    return [F.lit(source).alias("source"), company.alias("company"), title.alias("title"),
            location.alias("location"), url.alias("url"), desc.alias("description_html"),
            pid.cast("string").alias("posting_id")]


def normalise_greenhouse(raw: DataFrame) -> DataFrame:
    """``jobs[]``; location name defaults to ''; company is the board token."""
    j = raw.where(F.col("_corrupt_record").isNull()).select("board", F.explode("jobs").alias("j"))
    return j.select(*_post("greenhouse", F.col("board"), F.col("j.title"),
                           F.coalesce(F.col("j.location.name"), F.lit("")), F.col("j.absolute_url"),
                           F.coalesce(F.col("j.content"), F.lit("")), F.col("j.id")))


def normalise_lever(raw: DataFrame) -> DataFrame:
    """R2: top-level list; ``descriptionPlain`` else ``description``."""
    j = raw.where(F.col("_corrupt_record").isNull()).select("board", F.explode("postings").alias("j"))
    return j.select(*_post("lever", F.col("board"), F.col("j.text"),
                           F.coalesce(F.col("j.categories.location"), F.lit("")), F.col("j.hostedUrl"),
                           F.coalesce(F.col("j.descriptionPlain"), F.col("j.description"), F.lit("")),
                           F.col("j.id")))


def normalise_workday(raw: DataFrame) -> DataFrame:
    """Pages of ``jobPostings``; id = first bullet field else the path; the
    url is built from tenant, host, site and path; no description."""
    j = raw.where(F.col("_corrupt_record").isNull()).select("tenant", "host", "site",
                                                            F.explode("jobPostings").alias("j"))
    path = F.coalesce(F.col("j.externalPath"), F.lit(""))
    first = F.get(F.col("j.bulletFields"), 0)
    url = F.concat(F.lit("https://"), F.col("tenant"), F.lit("."), F.col("host"),
                   F.lit(".myworkdayjobs.com/"), F.col("site"), path)
    return j.select(*_post("workday", F.col("tenant"), F.coalesce(F.col("j.title"), F.lit("")),
                           F.coalesce(F.col("j.locationsText"), F.lit("")), url, F.lit(""),
                           F.when((first.isNotNull()) & (first != ""), first).otherwise(path)))


def normalise_ashby(raw: DataFrame) -> DataFrame:
    """``jobs[]`` straight projection."""
    j = raw.where(F.col("_corrupt_record").isNull()).select("board", F.explode("jobs").alias("j"))
    return j.select(*_post("ashby", F.col("board"), F.col("j.title"),
                           F.coalesce(F.col("j.location"), F.lit("")), F.col("j.jobUrl"),
                           F.coalesce(F.col("j.descriptionHtml"), F.lit("")), F.col("j.id")))


def normalise_remotive(raw: DataFrame) -> DataFrame:
    """Blank location becomes 'Remote'."""
    j = raw.where(F.col("_corrupt_record").isNull()).select(F.explode("jobs").alias("j"))
    loc = F.col("j.candidate_required_location")
    return j.select(*_post("remotive", F.coalesce(F.col("j.company_name"), F.lit("")),
                           F.col("j.title"), F.when(F.coalesce(loc, F.lit("")) == "", F.lit("Remote")).otherwise(loc),
                           F.col("j.url"), F.coalesce(F.col("j.description"), F.lit("")), F.col("j.id")))


# ---------------------------------------------------------------------------
# Files a user drops in: CSV postings (R15), url lists (R16), title rules
# ---------------------------------------------------------------------------

CSV_REQUIRED = ["company", "title", "location", "url", "description"]


def read_posting_csv(spark, path: str, source: str = "linkedin") -> DataFrame:
    """A posting CSV (header, quoted multi-line cells) with the five
    required columns (named exactly; an error otherwise); rows with a blank
    url are dropped; text cells stripped, the description kept as is; the id
    is sha1(url). The one-row manual form is the same shape."""
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .option("inferSchema", False).csv(path))
    missing = [c for c in CSV_REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"CSV is missing required column(s): {', '.join(sorted(missing))}")
    strip = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "(?U)^\\s+|\\s+$", "")
    return (df.where(strip("url") != "")
            .select(F.lit(source).alias("source"), strip("company").alias("company"),
                    strip("title").alias("title"), strip("location").alias("location"), strip("url").alias("url"),
                    F.coalesce("description", F.lit("")).alias("description_html"),
                    X.content_hash(strip("url")).alias("posting_id")))


def read_url_list(spark, path: str, scored: DataFrame | None = None) -> DataFrame:
    """Url list files -> urls in file order (file name, then line),
    blanks and '#' comments dropped, the first of repeated urls kept, urls
    already scored removed. A list file is small, so each is read whole."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.col("_metadata.file_path").alias("file"),
                       F.posexplode(F.split("value", "\\r?\\n")).alias("line_no", "line"))
    url = F.regexp_replace("line", "(?U)^\\s+|\\s+$", "")
    lines = lines.withColumn("url", url).where((F.col("url") != "") & ~F.col("url").startswith("#"))
    first = lines.groupBy("url").agg(F.min(F.struct("file", "line_no")).alias("pos"))
    if scored is not None:
        first = first.join(scored.select("url").where(F.col("url").isNotNull()), "url", "left_anti")
    return first.select("url", F.col("pos.file").alias("file"), F.col("pos.line_no").alias("line_no"))


TITLE_MODES_INCLUDE = ("include", "in", "keyword", "")
TITLE_MODES_EXCLUDE = ("exclude", "ex", "out")
TITLE_OFF = ("no", "false", "0", "off")


def title_rules(rules: DataFrame) -> DataFrame:
    """Title rule rows -> (term, kind) with kind include/exclude. Terms are
    stripped (a trailing space is lost, as in the loader); inactive rows are
    skipped; an unknown mode is reported as kind 'error'."""
    cols = {c.strip().lower(): c for c in rules.columns}
    if "term" not in cols or "mode" not in cols:
        raise ValueError("title rules need the columns term and mode")
    term = F.trim(F.coalesce(F.col(cols["term"]), F.lit("")))
    active = F.lower(F.trim(F.coalesce(F.col(cols["active"]), F.lit("yes")))) if "active" in cols else F.lit("yes")
    mode = F.lower(F.trim(F.coalesce(F.col(cols["mode"]), F.lit(""))))
    kind = (F.when(mode.isin(*TITLE_MODES_INCLUDE), "include")
            .when(mode.isin(*TITLE_MODES_EXCLUDE), "exclude").otherwise("error"))
    return (rules.where(term != "").where(~active.isin(*TITLE_OFF))
            .select(term.alias("term"), kind.alias("kind")))


def title_rule_lists(rules: DataFrame) -> tuple[list[str], list[str]]:
    """The include/exclude lists for the filters, which take terms as literals: one
    user's configuration, not data. Match a table of rules with ``rule_matches``."""
    r = title_rules(rules)
    rows = r.collect()
    bad = [x.term for x in rows if x.kind == "error"]
    if bad:
        raise ValueError(f"unknown mode for term(s): {', '.join(bad)}")
    inc = [x.term for x in rows if x.kind == "include"]
    if not inc:
        raise ValueError("no active include rows, so nothing would ever match")
    return inc, [x.term for x in rows if x.kind == "exclude"]


# --- search aggregators and paid actors (R5-R8, R10-R13) ---------------------

SMARTRECRUITERS_LIST_SCHEMA = ("company string, content array<struct<id:string, name:string,"
                               " location:struct<fullLocation:string, remote:boolean>>>, _corrupt_record string")
SMARTRECRUITERS_DETAIL_SCHEMA = ("id string, postingUrl string, jobAd struct<sections:map<string,"
                                 " struct<title:string, text:string>>>, _corrupt_record string")
WORKABLE_SCHEMA = ("account string, jobs array<struct<title:string, shortcode:string, city:string, state:string,"
                   " country:string, telecommuting:boolean, url:string, shortlink:string, description:string>>,"
                   " _corrupt_record string")
JOOBLE_SCHEMA = ("jobs array<struct<id:string, title:string, company:string, location:string, link:string,"
                 " snippet:string>>, _corrupt_record string")
ADZUNA_SCHEMA = ("results array<struct<id:string, title:string, company:struct<display_name:string>,"
                 " location:struct<display_name:string>, redirect_url:string, description:string>>,"
                 " _corrupt_record string")
JOBICY_SCHEMA = ("jobs array<struct<id:string, jobTitle:string, companyName:string, jobGeo:string, url:string,"
                 " jobDescription:string, jobExcerpt:string, salaryMin:string, salaryMax:string,"
                 " salaryCurrency:string, salaryPeriod:string>>, _corrupt_record string")
CAREERJET_SCHEMA = ("jobs array<struct<title:string, company:string, locations:string, url:string,"
                    " description:string, salary:string>>, _corrupt_record string")
LINKEDIN_SCHEMA = ("id string, jobId string, url string, link string, jobUrl string, title string,"
                   " companyName string, company string, location string, description string,"
                   " descriptionText string, salary string, _corrupt_record string")
INDEED_SCHEMA = ("key string, refNum string, title string, employer struct<name:string>,"
                 " location struct<city:string, admin1Code:string, countryName:string>,"
                 " description string, baseSalary string, jobUrl string, url string, _corrupt_record string")


def _ok(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("_corrupt_record").isNull())


def _nz(c) -> F.Column:
    """Python truthiness for a text cell: null and '' are false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def normalise_smartrecruiters(listing: DataFrame, detail: DataFrame, keywords) -> DataFrame:
    """List rows whose title has a term, joined to their detail rows on id
    (only those are looked up); description = the sections' texts joined by
    spaces; location = fullLocation, else 'Remote' when flagged, else ''."""
    from lantern.operators.filters import title_match
    rows = (_ok(listing).select("company", F.explode("content").alias("p"))
            .select("company", F.col("p.id").alias("id"), F.col("p.name").alias("title"),
                    F.col("p.location").alias("loc")))
    rows = rows.where(title_match(keywords, "title"))
    d = _ok(detail).select("id", "postingUrl", F.col("jobAd.sections").alias("sections"))
    j = rows.join(d, "id")
    # sections are a JSON object: values in key order of the object
    texts = F.transform(F.map_values("sections"), lambda s: F.coalesce(s["text"], F.lit("")))
    loc = F.coalesce(_nz(F.col("loc.fullLocation")),
                     F.when(F.coalesce(F.col("loc.remote"), F.lit(False)), F.lit("Remote")), F.lit(""))
    url = F.coalesce(F.col("postingUrl"), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("company"),
                                                   F.lit("/"), F.col("id")))
    return j.select(*_post("smartrecruiters", F.col("company"), F.coalesce("title", F.lit("")), loc, url,
                           F.array_join(texts, " "), F.col("id")))


def normalise_workable(raw: DataFrame) -> DataFrame:
    """City, state, country joined with ', ' skipping blanks; telecommuting
    gives 'Remote (…)' or 'Remote'."""
    j = _ok(raw).select("account", F.explode("jobs").alias("j"))
    parts = F.concat_ws(", ", _nz(F.col("j.city")), _nz(F.col("j.state")), _nz(F.col("j.country")))
    loc = F.when(F.coalesce(F.col("j.telecommuting"), F.lit(False)),
                 F.when(parts != "", F.concat(F.lit("Remote ("), parts, F.lit(")"))).otherwise(F.lit("Remote"))) \
        .otherwise(parts)
    return j.select(*_post("workable", F.col("account"), F.col("j.title"), loc,
                           F.coalesce(F.col("j.url"), F.col("j.shortlink"), F.lit("")),
                           F.coalesce(F.col("j.description"), F.lit("")), F.col("j.shortcode")))


def normalise_jooble(raw: DataFrame, source: str = "jooble") -> DataFrame:
    """``jobs[]``; the id is the job id, else its link."""
    j = _ok(raw).select(F.explode("jobs").alias("j"))
    return j.select(*_post(source, F.coalesce(F.col("j.company"), F.lit("")), F.coalesce(F.col("j.title"), F.lit("")),
                           F.coalesce(F.col("j.location"), F.lit("")), F.coalesce(F.col("j.link"), F.lit("")),
                           F.coalesce(F.col("j.snippet"), F.lit("")),
                           F.coalesce(F.col("j.id"), F.col("j.link"), F.lit(""))))


def normalise_adzuna(raw: DataFrame) -> DataFrame:
    """``results[]`` with nested company and location display names."""
    j = _ok(raw).select(F.explode("results").alias("j"))
    return j.select(*_post("adzuna", F.coalesce(F.col("j.company.display_name"), F.lit("")),
                           F.coalesce(F.col("j.title"), F.lit("")),
                           F.coalesce(F.col("j.location.display_name"), F.lit("")),
                           F.coalesce(F.col("j.redirect_url"), F.lit("")),
                           F.coalesce(F.col("j.description"), F.lit("")), F.coalesce(F.col("j.id"), F.lit(""))))


def normalise_jobicy(raw: DataFrame) -> DataFrame:
    """A ' [CUR min-max per]' suffix on the description when both ends
    are set (USD by default); location 'Remote (geo)' or 'Remote'."""
    j = _ok(raw).select(F.explode("jobs").alias("j"))
    both = F.coalesce(_nz(F.col("j.salaryMin")), F.lit(None)).isNotNull() & _nz(F.col("j.salaryMax")).isNotNull() \
        & (F.col("j.salaryMin") != "0") & (F.col("j.salaryMax") != "0")
    raw_sal = F.concat(F.lit(" ["), F.coalesce(F.col("j.salaryCurrency"), F.lit("USD")), F.lit(" "),
                       F.col("j.salaryMin"), F.lit("-"), F.col("j.salaryMax"), F.lit(" "),
                       F.coalesce(F.col("j.salaryPeriod"), F.lit("")), F.lit("]"))
    salary = F.when(both, F.replace(F.concat(F.regexp_replace(raw_sal, "(?U)\\s+$", ""), F.lit("]")),
                                    F.lit("]]"), F.lit("]"))).otherwise(F.lit(""))
    geo = F.regexp_replace(F.coalesce(F.col("j.jobGeo"), F.lit("")), "(?U)^\\s+|\\s+$", "")
    loc = F.when(geo != "", F.concat(F.lit("Remote ("), geo, F.lit(")"))).otherwise(F.lit("Remote"))
    desc = F.concat(F.coalesce(_nz(F.col("j.jobDescription")), _nz(F.col("j.jobExcerpt")), F.lit("")), salary)
    return j.select(*_post("jobicy", F.coalesce(F.col("j.companyName"), F.lit("")),
                           F.coalesce(F.col("j.jobTitle"), F.lit("")), loc, F.coalesce(F.col("j.url"), F.lit("")),
                           desc, F.coalesce(F.col("j.id"), F.lit(""))))


def normalise_careerjet(raw: DataFrame) -> DataFrame:
    """A ' [salary]' suffix when given; the id is sha1(url) (a
    stable id, where a per-process hash would not be)."""
    j = _ok(raw).select(F.explode("jobs").alias("j"))
    sal = F.when(_nz(F.col("j.salary")).isNotNull(), F.concat(F.lit(" ["), F.col("j.salary"), F.lit("]"))) \
        .otherwise(F.lit(""))
    url = F.coalesce(F.col("j.url"), F.lit(""))
    return j.select(*_post("careerjet", F.coalesce(F.col("j.company"), F.lit("")),
                           F.coalesce(F.col("j.title"), F.lit("")), F.coalesce(F.col("j.locations"), F.lit("")),
                           url, F.concat(F.coalesce(F.col("j.description"), F.lit("")), sal), X.content_hash(url)))


def normalise_linkedin(raw: DataFrame) -> DataFrame:
    """First non-empty of id/jobId and of url/link/jobUrl (else a view url
    from the id); a 'Salary:' line before the description when given."""
    r = _ok(raw)
    job_id = F.coalesce(_nz(F.col("id")), _nz(F.col("jobId")), F.lit(""))
    url = F.coalesce(_nz(F.col("url")), _nz(F.col("link")), _nz(F.col("jobUrl")),
                     F.when(job_id != "", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), job_id)),
                     F.lit(""))
    desc = F.coalesce(_nz(F.col("description")), _nz(F.col("descriptionText")), F.lit(""))
    desc = F.when(_nz(F.col("salary")).isNotNull(),
                  F.concat(F.lit("Salary: "), F.col("salary"), F.lit("\n\n"), desc)).otherwise(desc)
    return r.select(*_post("linkedin", F.coalesce(_nz(F.col("companyName")), _nz(F.col("company")), F.lit("")),
                           F.coalesce(F.col("title"), F.lit("")), F.coalesce(F.col("location"), F.lit("")), url,
                           desc, F.when(job_id != "", job_id).otherwise(X.content_hash(url))))


def normalise_indeed(raw: DataFrame) -> DataFrame:
    """R13: 'City, ST' (or the city alone when it says remote, else the
    country); description given as text or as {html, text}; a pay line from
    the structured salary (S11) first; jobUrl preferred over url."""
    from lantern.operators.pay import pay_line, pay_object
    r = _ok(raw)
    city = F.regexp_replace(F.coalesce(F.col("location.city"), F.lit("")), "(?U)^\\s+|\\s+$", "")
    state = F.regexp_replace(F.coalesce(F.col("location.admin1Code"), F.lit("")), "(?U)^\\s+|\\s+$", "")
    where = F.when(F.lower(city) == "remote", city).otherwise(F.concat_ws(", ", _nz(city), _nz(state)))
    loc = F.when(where != "", where).otherwise(F.coalesce(F.col("location.countryName"), F.lit("")))
    v = F.try_parse_json(F.col("description"))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    desc = F.when(is_obj, F.coalesce(_nz(F.try_variant_get(v, "$.html", "string")),
                                     _nz(F.try_variant_get(v, "$.text", "string")), F.lit(""))) \
        .otherwise(F.coalesce(F.col("description"), F.lit("")))
    pay = pay_object(F.col("baseSalary"))
    desc = F.when(pay.isNotNull(), F.concat(pay_line(pay), F.lit("\n\n"), desc)).otherwise(desc)
    key = F.coalesce(_nz(F.col("key")), _nz(F.col("refNum")), F.lit(""))
    url = F.coalesce(_nz(F.col("jobUrl")), _nz(F.col("url")), F.lit(""))
    fallback = F.coalesce(_nz(F.col("url")), F.coalesce(F.col("title"), F.lit("")))
    return r.select(*_post("indeed", F.coalesce(F.col("employer.name"), F.lit("")),
                           F.coalesce(F.col("title"), F.lit("")), loc, url, desc,
                           F.when(key != "", key).otherwise(X.content_hash(fallback))))


def rule_matches(titles: DataFrame, rules: DataFrame, key: str = "ingest_seq") -> DataFrame:
    """Titles against rules of any number: per ``key`` whether an include term occurs
    and no exclude term does. The title's substrings of the lengths that terms
    have are joined with the terms, so no title meets every rule."""
    r = title_rules(rules).select(F.lower("term").alias("term"), "kind").distinct()
    lengths = r.select(F.length("term").alias("n")).distinct().agg(F.collect_set("n")).scalar()
    t = titles.select(key, F.lower(F.coalesce("title", F.lit(""))).alias("_t"))
    cut = t.select(key, F.explode(lengths).alias("_n"), "_t").where(F.length("_t") >= F.col("_n"))
    cut = cut.select(key, F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1), lambda i: F.col("_t").substr(i, F.col("_n"))))).alias("term"))
    hits = cut.join(r, "term").groupBy(key).agg(
        F.bool_or(F.col("kind") == "include").alias("inc"), F.bool_or(F.col("kind") == "exclude").alias("exc"))
    return titles.select(key).join(hits, key, "left").select(
        key, (F.coalesce("inc", F.lit(False)) & ~F.coalesce("exc", F.lit(False))).alias("kept"))
