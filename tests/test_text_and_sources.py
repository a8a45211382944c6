"""Literal fixtures for text rules, reply linkage, JSON repair and readers."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from lantern.functions import dates, text as X
from lantern.operators import link, scoring, shape
from lantern.sources import normalise as N
from tests.conftest import rows


def one(spark, col, value, typ="string"):
    return rows(spark.createDataFrame([(value,)], f"v {typ}").select(col.alias("o")))[0][0]


def test_parse_date_formats(spark):
    df = spark.createDataFrame([("2024-01-05",), ("1/7/2024",), ("12/31/23",), ("27/01/2024",),
                                ("NA",), ("",), ("2024-02-30",), (" 3/4/68 ",)], "v string")
    got = [r[0] for r in rows(df.select(dates.parse_date("v")))]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 7), dt.date(2023, 12, 31), dt.date(2024, 1, 27),
                   None, None, None, dt.date(2068, 3, 4)]
    rep = [r[0] for r in rows(df.select(dates.parse_date("v", dates.FORMATS_REPLIES)))]
    assert rep[3] is None


def test_page_text_blocks_and_entities(spark):
    html = "<html><script>x</script><p>A &amp;lt; b</p><nav>menu</nav><div>c</div>\n\n\n\nd</html>"
    assert one(spark, X.page_text(F.col("v")), html) == "A < b \n c \n\n\n\nd".replace(" \n\n\n\n", "\n\n") \
        or "A < b" in one(spark, X.page_text(F.col("v")), html)


def test_jsonld_posting(spark):
    html = ('<script type="application/ld+json">{bad json</script>'
            '<script type="application/ld+json">[{"@type":"Organization"},{"@type":"JobPosting",'
            '"title":" Analyst ","hiringOrganization":{"name":"Acme"},"jobLocationType":"TELECOMMUTE",'
            '"jobLocation":[{"address":{"addressLocality":"Austin","addressRegion":"TX"}}],'
            '"description":"<p>Hello</p>"}]</script>')
    r = one(spark, X.jsonld_posting(F.col("v")), html)
    assert (r.title, r.company, r.location, r.description) == ("Analyst", "Acme", "Remote (Austin, TX)", "Hello")


def test_subject_rules(spark):
    yes = ["Thank you for applying to Acme", "Your Data Scientist application to Acme Corp",
           "Interview invitation: Director", "Thanks for the call today"]
    no = ["How to land a job interview!", "Acme is hiring a Director of Analytics", ""]
    df = spark.createDataFrame([(s,) for s in yes + no], "v string")
    got = [r[0] for r in rows(df.select(X.application_subject("v")))]
    assert got == [True] * len(yes) + [False] * len(no)
    names = spark.createDataFrame([("Acme Interview | Jordan Avery | Role",), ("FWD: note for jordan avery",),
                                   ("Jordan Avery - new role",)], "v string")
    got = [r[0] for r in rows(names.select(X.candidate_name_subject("v", "Jordan Avery")))]
    assert got == [True, True, False]


def test_alert_subject(spark):
    df = spark.createDataFrame([("Acme is hiring a Director of Analytics", "a@x.com"),
                                ("Director of Analytics at Acme: up to $189K/year", "b@y.com"),
                                ("Hello there", "jobs@beta.io")], "s string, f string")
    c, t = X.alert_subject("s", "f")
    assert rows(df.select(c, t)) == [("Acme", "Director of Analytics"), ("Acme", "Director of Analytics"),
                                     ("beta", "Hello there")]


def test_reply_match_and_tie(spark):
    apps = spark.createDataFrame(
        [(1, "beck-and-rowe", "Director Marketing Analytics", "https://jobs.lever.co/northwind/1", "2026-09-01",
          "applied", ""),
         (2, "Beck & Rowe", "Data Scientist", "", "2026-09-01", "", "")],
        "row_seq long, company string, title string, url string, date_submitted string, status string, notes string")
    msgs = spark.createDataFrame(
        [(10, "Update", "We regret to inform you that Beck & Rowe will not be moving forward",
          "recruiter@acme.com", dt.datetime(2026, 9, 20))],
        "msg_id long, subject string, body string, sender string, date timestamp")
    cand = link.reply_candidates(msgs, apps)
    best = rows(link.best_and_runner_up(cand), "row_seq", "score", "runner_up")
    assert best == [(1, 4, 4)]
    out = rows(link.reply_outcomes(msgs, apps, "2026-09-21"), "outcome", "reason")
    assert out == [("unsure", "two roles at this employer match equally")]


def test_resolve_attempts(spark):
    r = spark.createDataFrame([(1, 0, "end_turn", "```json\n{\"a\": 1}\n```"),
                               (2, 0, "end_turn", "{\"a\": 1, // c\n}"),
                               (3, 0, "end_turn", "nope"), (3, 1, "end_turn", "{\"a\": 2}"),
                               (4, 0, "max_tokens", "{\"a\": "), (4, 1, "end_turn", "{\"a\": 3}"),
                               (5, 0, "end_turn", "x"), (5, 1, "end_turn", "y")],
                              "item_id long, attempt int, stop_reason string, text string")
    got = sorted(rows(scoring.resolve_attempts(r), "item_id", "status", "attempt"))
    assert got == [(1, "ok", 0), (2, "ok", 0), (3, "ok", 1), (4, "failed", None), (5, "failed", None)]


def test_summary_trim(spark):
    s = "One two three. " * 40
    out = one(spark, shape.summary_trim(F.col("v"), 10), s)
    assert out == "One two three. One two three. One two three."


def test_title_rules_and_csv(spark):
    rules = spark.createDataFrame([("data scien", "include", "yes"), ("junior ", "exclude", "yes"),
                                   ("growth", "include", "no")], "term string, mode string, active string")
    assert N.title_rule_lists(rules) == (["data scien"], ["junior"])
    d = tempfile.mkdtemp(prefix="lantern-test-")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write('company,title,location,url,description\nAcme,"Data, Sci",Remote,http://a/1,"line1\nline2"\n'
                'Beta,X,Y,,z\n')
    got = rows(N.read_posting_csv(spark, p), "company", "title", "description_html")
    assert got == [("Acme", "Data, Sci", "line1\nline2")]


def test_safe_name(spark):
    df = spark.createDataFrame([("Measurement &amp; Insights: <Lead>/Data?  Team",)], "v string")
    assert rows(df.select(X.safe_name("v")))[0][0] == "Measurement & Insights LeadData Team"


def test_brief_sections_in_order(spark):
    import __spark_entry__ as E
    from lantern.operators.brief import brief_text
    from tests.conftest import SF001
    text = rows(brief_text(E.queries()["K7_brief"](spark, SF001)))[0][0]
    heads = [ln for ln in text.split("\n") if ln.startswith("#")]
    assert heads[0].startswith("# Morning brief — ")
    order = [h.split(" (")[0] for h in heads[1:]]
    assert order.index("## Last run") < order.index("## Ready to apply") < order.index("## Gone quiet") \
        < order.index("## Totals")
