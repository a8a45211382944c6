"""Source normaliser queries: postings are landed as each board's JSON
response shape, read back with the fixed schemas and normalised (R1-R4, R9,
U1). The payload files go to the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lantern.plans.registry import register
from lantern.plans.tables import adapter, read_table
from lantern.session import checkpoint_dir
from lantern.sources import normalise as N

# posting source -> the board shape it is landed as
SHAPES = {"greenhouse": "greenhouse", "lever": "lever", "linkedin": "ashby", "indeed": "workday",
          "email": "remotive"}


def _land(spark, df, name):
    path = f"{checkpoint_dir(spark).rstrip('/')}/landed-{name}-{uuid.uuid4().hex[:10]}"
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.text(path)
    return path


def landed_sources(spark, sf):
    p = adapter(spark, sf, "postings")
    gh = p.where(F.col("source") == "greenhouse").select(
        F.col("company").alias("board"),
        F.array(F.struct(F.col("ingest_seq").alias("id"), "title", F.struct(F.col("location").alias("name"))
                         .alias("location"), F.col("url").alias("absolute_url"),
                         F.col("description_html").alias("content"))).alias("jobs"))
    lv = p.where(F.col("source") == "lever").select(
        F.col("company").alias("board"),
        F.array(F.struct(F.col("posting_id").alias("id"), F.col("title").alias("text"),
                         F.struct(F.col("location").alias("location")).alias("categories"),
                         F.col("url").alias("hostedUrl"), F.col("description_html").alias("description")))
        .alias("postings"))
    ab = p.where(F.col("source") == "linkedin").select(
        F.col("company").alias("board"),
        F.array(F.struct(F.col("posting_id").alias("id"), "title", "location", F.col("url").alias("jobUrl"),
                         F.col("description_html").alias("descriptionHtml"))).alias("jobs"))
    wd = p.where(F.col("source") == "indeed").select(
        F.lower(F.split_part("company", F.lit(" "), F.lit(1))).alias("tenant"), F.lit("wd5").alias("host"),
        F.lit("External").alias("site"),
        F.array(F.struct("title", F.col("location").alias("locationsText"),
                         F.concat(F.lit("/job/"), F.col("posting_id")).alias("externalPath"),
                         F.when(F.col("ingest_seq") % 2 == 0, F.array(F.col("posting_id")))
                         .otherwise(F.array().cast("array<string>")).alias("bulletFields"))).alias("jobPostings"))
    rm = p.where(F.col("source") == "email").select(
        F.array(F.struct(F.col("ingest_seq").alias("id"), "title", F.col("company").alias("company_name"),
                         F.when(F.col("location").startswith("Remote"), F.lit("")).otherwise(F.col("location"))
                         .alias("candidate_required_location"), "url",
                         F.col("description_html").alias("description"))).alias("jobs"))
    out = [
        N.normalise_greenhouse(N.read_payloads(spark, _land(spark, gh, "gh"), N.GREENHOUSE_SCHEMA)),
        N.normalise_lever(N.read_payloads(spark, _land(spark, lv, "lever"), N.LEVER_SCHEMA)),
        N.normalise_ashby(N.read_payloads(spark, _land(spark, ab, "ashby"), N.ASHBY_SCHEMA)),
        N.normalise_workday(N.read_payloads(spark, _land(spark, wd, "wd"), N.WORKDAY_SCHEMA)),
        N.normalise_remotive(N.read_payloads(spark, _land(spark, rm, "rm"), N.REMOTIVE_SCHEMA)),
    ]
    u = out[0]
    for o in out[1:]:
        u = u.unionByName(o)
    return u


@register("U1_union_sources", oracle="""
SELECT 'greenhouse' AS source, company, title, location, url, CAST(ingest_seq AS VARCHAR) AS posting_id
FROM {postings} WHERE source = 'greenhouse'
UNION ALL SELECT 'lever', company, title, location, url, posting_id FROM {postings} WHERE source = 'lever'
UNION ALL SELECT 'ashby', company, title, location, url, posting_id FROM {postings} WHERE source = 'linkedin'
UNION ALL SELECT 'workday', lower(split_part(company, ' ', 1)), title, location,
       'https://' || lower(split_part(company, ' ', 1)) || '.wd5.myworkdayjobs.com/External/job/' || posting_id,
       CASE WHEN ingest_seq % 2 = 0 THEN posting_id ELSE '/job/' || posting_id END
FROM {postings} WHERE source = 'indeed'
UNION ALL SELECT 'remotive', company, title, CASE WHEN starts_with(location, 'Remote') THEN 'Remote' ELSE location END,
       url, CAST(ingest_seq AS VARCHAR) FROM {postings} WHERE source = 'email'
""")
def u1(spark, sf):
    return landed_sources(spark, sf).select("source", "company", "title", "location", "url", "posting_id")


# --- one query per source shape: every posting landed in that shape ----------

OUT = ["source", "company", "title", "location", "url", "description_html", "posting_id"]


def _read(spark, df, name, schema):
    return N.read_payloads(spark, _land(spark, df, name), schema)


def _p(spark, sf):
    return adapter(spark, sf, "postings")


def _seq_mod(n):
    return F.col("ingest_seq") % n


@register("R1_greenhouse", oracle="""
SELECT 'greenhouse' AS source, company, title, coalesce(location, '') AS location, url,
       description_html, CAST(ingest_seq AS VARCHAR) AS posting_id FROM {postings}""")
def r1(spark, sf):
    p = _p(spark, sf)
    gh = p.select(F.col("company").alias("board"), F.array(F.struct(
        F.col("ingest_seq").alias("id"), "title", F.struct(F.col("location").alias("name")).alias("location"),
        F.col("url").alias("absolute_url"), F.col("description_html").alias("content"))).alias("jobs"))
    return N.normalise_greenhouse(_read(spark, gh, "gh", N.GREENHOUSE_SCHEMA)).select(*OUT)


@register("R2_lever", oracle="""
SELECT 'lever' AS source, company, title, location, url, description_html, posting_id FROM {postings}""")
def r2(spark, sf):
    p = _p(spark, sf)
    lv = p.select(F.col("company").alias("board"), F.array(F.struct(
        F.col("posting_id").alias("id"), F.col("title").alias("text"),
        F.struct(F.col("location").alias("location")).alias("categories"), F.col("url").alias("hostedUrl"),
        F.when(_seq_mod(2) == 0, F.col("description_html")).alias("descriptionPlain"),
        F.col("description_html").alias("description"))).alias("postings"))
    return N.normalise_lever(_read(spark, lv, "lever", N.LEVER_SCHEMA)).select(*OUT)


@register("R3_workday", oracle="""
SELECT 'workday' AS source, lower(split_part(company, ' ', 1)) AS company, title, location,
       'https://' || lower(split_part(company, ' ', 1)) || '.wd5.myworkdayjobs.com/External/job/' || posting_id AS url,
       '' AS description_html,
       CASE WHEN ingest_seq % 2 = 0 THEN posting_id ELSE '/job/' || posting_id END AS posting_id
FROM {postings}""")
def r3(spark, sf):
    p = _p(spark, sf)
    wd = p.select(
        F.lower(F.split_part("company", F.lit(" "), F.lit(1))).alias("tenant"), F.lit("wd5").alias("host"),
        F.lit("External").alias("site"),
        F.array(F.struct("title", F.col("location").alias("locationsText"),
                         F.concat(F.lit("/job/"), F.col("posting_id")).alias("externalPath"),
                         F.when(_seq_mod(2) == 0, F.array(F.col("posting_id")))
                         .otherwise(F.array().cast("array<string>")).alias("bulletFields"))).alias("jobPostings"))
    return N.normalise_workday(_read(spark, wd, "wd", N.WORKDAY_SCHEMA)).select(*OUT)


@register("R4_ashby", oracle="""
SELECT 'ashby' AS source, company, title, location, url, description_html, posting_id FROM {postings}""")
def r4(spark, sf):
    p = _p(spark, sf)
    ab = p.select(F.col("company").alias("board"), F.array(F.struct(
        F.col("posting_id").alias("id"), "title", "location", F.col("url").alias("jobUrl"),
        F.col("description_html").alias("descriptionHtml"))).alias("jobs"))
    return N.normalise_ashby(_read(spark, ab, "ashby", N.ASHBY_SCHEMA)).select(*OUT)


@register("R5_smartrecruiters", oracle=f"""
SELECT 'smartrecruiters' AS source, lower(company) AS company, title,
       CASE WHEN starts_with(location, 'Remote') THEN 'Remote' ELSE location END AS location,
       CASE WHEN ingest_seq % 3 = 0
            THEN 'https://jobs.smartrecruiters.com/' || lower(company) || '/' || CAST(ingest_seq AS VARCHAR)
            ELSE url END AS url,
       company || ' ' || description_html AS description_html,
       CAST(ingest_seq AS VARCHAR) AS posting_id
FROM {{postings}} WHERE {__import__('lantern.plans.q_intake', fromlist=['SQL_P1']).SQL_P1}""")
def r5(spark, sf):
    from lantern.plans.settings import KEYWORDS
    p = _p(spark, sf)
    remote = F.col("location").startswith("Remote")
    listing = p.select(F.lower("company").alias("company"), F.array(F.struct(
        F.col("ingest_seq").cast("string").alias("id"), F.col("title").alias("name"),
        F.struct(F.when(remote, F.lit("")).otherwise(F.col("location")).alias("fullLocation"),
                 remote.alias("remote")).alias("location"))).alias("content"))
    detail = p.select(F.col("ingest_seq").cast("string").alias("id"),
                      F.when(_seq_mod(3) == 0, F.lit(None)).otherwise(F.col("url")).alias("postingUrl"),
                      F.struct(F.create_map(
                          F.lit("companyDescription"), F.struct(F.lit("About").alias("title"),
                                                                F.col("company").alias("text")),
                          F.lit("jobDescription"), F.struct(F.lit("Job").alias("title"),
                                                            F.col("description_html").alias("text"))
                      ).alias("sections")).alias("jobAd"))
    out = N.normalise_smartrecruiters(_read(spark, listing, "srl", N.SMARTRECRUITERS_LIST_SCHEMA),
                                      _read(spark, detail, "srd", N.SMARTRECRUITERS_DETAIL_SCHEMA), KEYWORDS)
    return out.select(*OUT)


@register("R6_workable", oracle="""
SELECT 'workable' AS source, company, title,
       CASE WHEN starts_with(location, 'Remote') THEN
              CASE WHEN parts <> '' THEN 'Remote (' || parts || ')' ELSE 'Remote' END
            ELSE parts END AS location,
       CASE WHEN ingest_seq % 2 = 0 THEN url ELSE url || '?s' END AS url, description_html, posting_id
FROM (SELECT *, concat_ws(', ', nullif(split_part(location, ', ', 1), ''), nullif(split_part(location, ', ', 2), ''),
                          nullif(split_part(location, ', ', 3), '')) AS parts FROM {postings})""")
def r6(spark, sf):
    p = _p(spark, sf)
    wk = p.select(F.col("company").alias("account"), F.array(F.struct(
        "title", F.col("posting_id").alias("shortcode"),
        F.split_part("location", F.lit(", "), F.lit(1)).alias("city"),
        F.split_part("location", F.lit(", "), F.lit(2)).alias("state"),
        F.split_part("location", F.lit(", "), F.lit(3)).alias("country"),
        F.col("location").startswith("Remote").alias("telecommuting"),
        F.when(_seq_mod(2) == 0, F.col("url")).alias("url"), F.concat("url", F.lit("?s")).alias("shortlink"),
        F.col("description_html").alias("description"))).alias("jobs"))
    return N.normalise_workable(_read(spark, wk, "workable", N.WORKABLE_SCHEMA)).select(*OUT)


@register("R7_jooble", oracle="""
SELECT 'jooble' AS source, company, title, location, url, description_html AS description_html,
       CASE WHEN ingest_seq % 4 = 0 THEN url ELSE posting_id END AS posting_id FROM {postings}""")
def r7(spark, sf):
    p = _p(spark, sf)
    jb = p.select(F.array(F.struct(
        F.when(_seq_mod(4) == 0, F.lit(None)).otherwise(F.col("posting_id")).alias("id"), "title", "company",
        "location", F.col("url").alias("link"), F.col("description_html").alias("snippet")))
        .alias("jobs"))
    return N.normalise_jooble(_read(spark, jb, "jooble", N.JOOBLE_SCHEMA)).select(*OUT)


@register("R8_adzuna", oracle="""
SELECT 'adzuna' AS source, company, title, location, url, description_html AS description_html,
       posting_id FROM {postings}""")
def r8(spark, sf):
    p = _p(spark, sf)
    az = p.select(F.array(F.struct(
        F.col("posting_id").alias("id"), "title", F.struct(F.col("company").alias("display_name")).alias("company"),
        F.struct(F.col("location").alias("display_name")).alias("location"), F.col("url").alias("redirect_url"),
        F.col("description_html").alias("description"))).alias("results"))
    return N.normalise_adzuna(_read(spark, az, "adzuna", N.ADZUNA_SCHEMA)).select(*OUT)


@register("R9_remotive", oracle="""
SELECT 'remotive' AS source, company, title,
       CASE WHEN starts_with(location, 'Remote') THEN 'Remote' ELSE location END AS location, url,
       description_html, CAST(ingest_seq AS VARCHAR) AS posting_id FROM {postings}""")
def r9(spark, sf):
    p = _p(spark, sf)
    rm = p.select(F.array(F.struct(
        F.col("ingest_seq").alias("id"), "title", F.col("company").alias("company_name"),
        F.when(F.col("location").startswith("Remote"), F.lit("")).otherwise(F.col("location"))
        .alias("candidate_required_location"), "url", F.col("description_html").alias("description"))).alias("jobs"))
    return N.normalise_remotive(_read(spark, rm, "rm", N.REMOTIVE_SCHEMA)).select(*OUT)


@register("R10_jobicy", oracle="""
SELECT 'jobicy' AS source, company, title,
       CASE WHEN starts_with(location, 'Remote') THEN 'Remote' ELSE 'Remote (' || location || ')' END AS location,
       url,
       CASE WHEN ingest_seq % 2 = 0 THEN description_html ELSE 'excerpt' END
       || CASE WHEN ingest_seq % 3 = 0 THEN ''
               ELSE ' [' || CASE WHEN ingest_seq % 5 = 0 THEN 'USD' ELSE 'EUR' END || ' '
                    || CAST(50000 + ingest_seq AS VARCHAR) || '-' || CAST(90000 + ingest_seq AS VARCHAR)
                    || CASE WHEN ingest_seq % 2 = 0 THEN ' year' ELSE ' ' END || ']' END AS description_html,
       CAST(ingest_seq AS VARCHAR) AS posting_id FROM {postings}""")
def r10(spark, sf):
    p = _p(spark, sf)
    jc = p.select(F.array(F.struct(
        F.col("ingest_seq").cast("string").alias("id"), F.col("title").alias("jobTitle"),
        F.col("company").alias("companyName"),
        F.when(F.col("location").startswith("Remote"), F.lit("")).otherwise(F.col("location")).alias("jobGeo"),
        "url", F.when(_seq_mod(2) == 0, F.col("description_html")).otherwise(F.lit(""))
        .alias("jobDescription"), F.lit("excerpt").alias("jobExcerpt"),
        F.when(_seq_mod(3) == 0, F.lit(None)).otherwise((F.col("ingest_seq") + 50000).cast("string"))
        .alias("salaryMin"), (F.col("ingest_seq") + 90000).cast("string").alias("salaryMax"),
        F.when(_seq_mod(5) == 0, F.lit(None)).otherwise(F.lit("EUR")).alias("salaryCurrency"),
        F.when(_seq_mod(2) == 0, F.lit("year")).otherwise(F.lit("")).alias("salaryPeriod"))).alias("jobs"))
    return N.normalise_jobicy(_read(spark, jc, "jobicy", N.JOBICY_SCHEMA)).select(*OUT)


@register("R11_careerjet", oracle="""
SELECT 'careerjet' AS source, company, title, location, url,
       description_html || CASE WHEN ingest_seq % 2 = 0 THEN ' [$' || CAST(ingest_seq AS VARCHAR) || ']'
                                              ELSE '' END AS description_html,
       sha1(url) AS posting_id FROM {postings}""")
def r11(spark, sf):
    p = _p(spark, sf)
    cj = p.select(F.array(F.struct(
        "title", "company", F.col("location").alias("locations"), "url",
        F.col("description_html").alias("description"),
        F.when(_seq_mod(2) == 0, F.concat(F.lit("$"), F.col("ingest_seq").cast("string"))).alias("salary")))
        .alias("jobs"))
    return N.normalise_careerjet(_read(spark, cj, "careerjet", N.CAREERJET_SCHEMA)).select(*OUT)


@register("R12_linkedin", oracle="""
SELECT 'linkedin' AS source, company, title, location,
       CASE WHEN ingest_seq % 4 = 0 THEN 'https://www.linkedin.com/jobs/view/' || jid ELSE url END AS url,
       CASE WHEN ingest_seq % 2 = 0 THEN 'Salary: $100K/yr' || chr(10) || chr(10) ELSE '' END
         || description_html AS description_html,
       jid AS posting_id
FROM (SELECT *, CASE WHEN ingest_seq % 3 = 0 THEN 'J' || CAST(ingest_seq AS VARCHAR) ELSE posting_id END AS jid
      FROM {postings})""")
def r12(spark, sf):
    p = _p(spark, sf)
    li = p.select(
        F.when(_seq_mod(3) == 0, F.lit(None)).otherwise(F.col("posting_id")).alias("id"),
        F.when(_seq_mod(3) == 0, F.concat(F.lit("J"), F.col("ingest_seq").cast("string"))).alias("jobId"),
        F.when(_seq_mod(4) == 0, F.lit(None)).otherwise(F.col("url")).alias("url"), "title",
        F.when(_seq_mod(5) == 0, F.lit(None)).otherwise(F.col("company")).alias("companyName"),
        F.col("company"), "location", F.col("description_html").alias("description"),
        F.when(_seq_mod(2) == 0, F.lit("$100K/yr")).alias("salary"))
    return N.normalise_linkedin(_read(spark, li, "linkedin", N.LINKEDIN_SCHEMA)).select(*OUT)


@register("R13_indeed", oracle="""
SELECT 'indeed' AS source, company, title,
       CASE WHEN starts_with(location, 'Remote') THEN 'Remote'
            ELSE concat_ws(', ', nullif(split_part(location, ', ', 1), ''), nullif(split_part(location, ', ', 3), ''))
            END AS location,
       url,
       CASE WHEN ingest_seq % 2 = 0 THEN 'Salary: $' || format('{{:,}}', 100000 + ingest_seq) || ' - $'
                 || format('{{:,}}', 150000 + ingest_seq) || ' per year' || chr(10) || chr(10) ELSE '' END
         || description_html AS description_html,
       CASE WHEN ingest_seq % 3 = 0
            THEN sha1(CASE WHEN ingest_seq % 4 < 2 THEN title ELSE url END)
            ELSE posting_id END AS posting_id
FROM {postings}""")
def r13(spark, sf):
    p = _p(spark, sf)
    remote = F.col("location").startswith("Remote")
    loc = F.struct(F.when(remote, F.lit("Remote")).otherwise(F.split_part("location", F.lit(", "), F.lit(1)))
                   .alias("city"),
                   F.when(remote, F.lit("")).otherwise(F.split_part("location", F.lit(", "), F.lit(3)))
                   .alias("admin1Code"), F.lit("US").alias("countryName"))
    base = p.select(F.when(_seq_mod(3) == 0, F.lit(None)).otherwise(F.col("posting_id")).alias("key"), "title",
                    F.struct(F.col("company").alias("name")).alias("employer"), loc.alias("location"),
                    F.col("description_html").alias("d"), "url", "ingest_seq")
    pay = F.when(_seq_mod(2) == 0, F.struct((F.col("ingest_seq") + 100000).alias("min"),
                                            (F.col("ingest_seq") + 150000).alias("max"),
                                            F.lit("YEAR").alias("unitOfWork")))
    as_text = base.where(_seq_mod(4) < 2).select("key", "title", "employer", "location",
                                                 F.col("d").alias("description"), pay.alias("baseSalary"),
                                                 F.col("url").alias("jobUrl"))
    as_obj = base.where(_seq_mod(4) >= 2).select("key", "title", "employer", "location",
                                                 F.struct(F.col("d").alias("html"), F.lit("plain").alias("text"))
                                                 .alias("description"), pay.alias("baseSalary"), "url")
    path = _land(spark, as_text, "indeed")
    as_obj.select(F.to_json(F.struct(*as_obj.columns)).alias("value")).write.mode("append").text(path)
    return N.normalise_indeed(N.read_payloads(spark, path, N.INDEED_SCHEMA)).select(*OUT)


def _scratch(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:10]}"


@register("R15_csv_postings", oracle="""
SELECT 'linkedin' AS source, regexp_replace(company, '^\\s+|\\s+$', '', 'g') AS company,
       regexp_replace(title, '^\\s+|\\s+$', '', 'g') AS title,
       regexp_replace(location, '^\\s+|\\s+$', '', 'g') AS location, url, description_html,
       sha1(url) AS posting_id
FROM {postings} WHERE NOT (ingest_seq % 10 = 0)""")
def r15(spark, sf):
    """Postings exported as a CSV (every tenth with a blank url), read back."""
    p = _p(spark, sf)
    out = p.select("company", "title", "location",
                   F.when(_seq_mod(10) == 0, F.lit("  ")).otherwise(F.col("url")).alias("url"),
                   F.col("description_html").alias("description"))
    path = _scratch(spark, "csv")
    out.write.option("header", True).option("escape", '"').option("quoteAll", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return N.read_posting_csv(spark, path)


@register("R16_url_list", oracle="""
SELECT DISTINCT url FROM {postings} WHERE url NOT IN (SELECT url FROM {scored})""")
def r16(spark, sf):
    """Every posting url written to list files in posting order, with comment
    lines, blank lines and repeats, read back minus the scored ones."""
    p = _p(spark, sf)
    items = F.array(
        F.when(_seq_mod(7) == 0, F.concat(F.lit("# from "), F.col("source"))),
        F.col("url"),
        F.when(_seq_mod(5) == 0, F.concat(F.lit("  "), F.col("url"))),
        F.when(_seq_mod(3) == 0, F.lit("")))
    lines = p.select("ingest_seq", F.explode(F.array_compact(items)).alias("value"))
    path = _scratch(spark, "urls")
    lines.orderBy("ingest_seq").select("value").write.text(path)
    return N.read_url_list(spark, path, adapter(spark, sf, "scored")).select("url")


@register("R17_title_rules", oracle="""
SELECT trim(p_name) AS term,
       CASE WHEN lower(trim(mode)) IN ('include', 'in', 'keyword', '') THEN 'include'
            WHEN lower(trim(mode)) IN ('exclude', 'ex', 'out') THEN 'exclude' ELSE 'error' END AS kind
FROM (SELECT p_name, p_size,
             CASE p_size % 6 WHEN 0 THEN 'include' WHEN 1 THEN ' Exclude ' WHEN 2 THEN 'in'
                             WHEN 3 THEN '' WHEN 4 THEN 'out' ELSE 'maybe' END AS mode FROM {part})
WHERE trim(p_name) <> '' AND lower(CASE WHEN p_size % 9 = 0 THEN 'off' ELSE 'yes' END) NOT IN ('no', 'false', '0', 'off')""")
def r17(spark, sf):
    """Part names written as a title-rules CSV (modes in several spellings,
    some rows switched off), read back and classified."""
    from pyspark.sql import functions as G
    part = read_table(spark, sf, "part")
    mode = (G.when(G.col("p_size") % 6 == 0, "include").when(G.col("p_size") % 6 == 1, " Exclude ")
            .when(G.col("p_size") % 6 == 2, "in").when(G.col("p_size") % 6 == 3, "")
            .when(G.col("p_size") % 6 == 4, "out").otherwise("maybe"))
    rules = part.select(G.col("p_name").alias("term"), mode.alias("mode"),
                        G.when(G.col("p_size") % 9 == 0, "off").otherwise("yes").alias("active"),
                        G.lit("").alias("notes"))
    path = _scratch(spark, "titles")
    rules.write.option("header", True).option("quoteAll", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return N.title_rules(back)


@register("P10_sender_filter", oracle="""
SELECT msg_id, sender FROM {messages}
WHERE NOT contains(coalesce(sender, ''), 'system')
  AND (contains(coalesce(sender, ''), 'user') OR contains(coalesce(sender, ''), 'assistant'))""")
def p10(spark, sf):
    from lantern.operators.filters import sender_filter
    return sender_filter(adapter(spark, sf, "messages"), ["user", "assistant"], ["system"]).select("msg_id", "sender")
