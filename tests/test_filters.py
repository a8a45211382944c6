"""Title, exclusion, location and routing rules on literal postings."""

from pyspark.sql import functions as F

from lantern.operators import dedupe, filters, reports
from tests.conftest import rows

TERMS = ["kiln", "tile plan", "glaze chem", "floor cost"]
EXCLUDES = ["trainee", "night shift", "deputy ", "kiln seller"]
SCHEMA = ("ingest_seq long, source string, company string, title string, location string, "
          "url string, description_html string, posting_id string")


def posting(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def _p(i, title, location="Remote", source="greenhouse", company="Acme", pid=None):
    return (i, source, company, title, location, f"u{i}", "", pid or f"p{i}")


def test_title_match_both_directions(spark):
    df = posting(spark, [_p(1, "Lead Glaze Chemist, Blue"), _p(2, "HEAD - TILE PLANNING"),
                         _p(3, "Shop Painter")])
    got = sorted(r[0] for r in rows(df.where(filters.title_match(TERMS)), "ingest_seq"))
    assert got == [1, 2]


def test_exclusion_and_keep(spark):
    df = posting(spark, [_p(1, "Tile Planning Trainee"), _p(2, "Deputyship, Tile Planning")])
    kept = filters.keyword_filter(df, TERMS, [], EXCLUDES)
    assert [r[0] for r in rows(kept, "ingest_seq")] == [2]


def test_no_keywords_matches_nothing(spark):
    df = posting(spark, [_p(1, "Kiln Fitter")])
    assert filters.keyword_filter(df, [], [], []).count() == 0


def test_reason_order_excluded_before_no_term(spark):
    df = posting(spark, [_p(1, "Kiln Seller, Ovens")])
    r = rows(df.select(filters.drop_reason(TERMS, EXCLUDES).alias("r")))[0][0]
    assert r == "title excluded: kiln seller"


def test_location_rules(spark):
    df = posting(spark, [_p(1, "x", "Erie, PA"), _p(2, "x", "Ocala, FL"), _p(3, "x", "Remote - US"),
                         _p(4, "x", "Painted Post"), _p(5, "x", "Utica, NY")])
    got = sorted(r[0] for r in rows(df.where(filters.location_match(["pennsylvania", "ny"])), "ingest_seq"))
    assert got == [1, 3, 5]


def test_role_dedupe_keeps_first(spark):
    df = posting(spark, [_p(1, "Kiln Fitter", "Remote", "linkedin", "Acme", "a"),
                         _p(2, "kiln fitter ", "Oslo", "linkedin", "acme", "b"),
                         _p(3, "Kiln Fitter", "Remote", "greenhouse", "Acme", "c"),
                         _p(4, "Kiln Fitter", "Remote", "greenhouse", "Acme", "c")])
    out = dedupe.dedupe_role(dedupe.dedupe_posting_key(df))
    assert sorted(r[0] for r in rows(out, "ingest_seq")) == [1, 3]


def test_keep_first_order_independent(spark):
    data = [_p(i, "Kiln Fitter", pid="same") for i in range(20, 0, -1)]
    df = posting(spark, data).repartition(7)
    out = dedupe.dedupe_posting_key(df)
    assert rows(out, "ingest_seq") == [(1,)]


def test_drop_report_titles(spark):
    data = [(i, "linkedin", "no title term matched", f"Title {i % 9}", "", "", "") for i in range(1, 19)]
    dropped = spark.createDataFrame(
        data, "ingest_seq long, source string, reason string, title string, company string, location string, url string")
    rep = rows(reports.drop_report(dropped))[0]
    assert rep[1] == 18 and rep[2] == 18
    assert rep[5].count(" | ") == 5
    assert rep[6] == 3


def test_company_block_compacts(spark):
    df = posting(spark, [_p(1, "x", company="Moss & Son, Ltd."), _p(2, "x", company="Other")])
    out = filters.company_block(df, ["moss-&-son"])
    assert [r[0] for r in rows(out, "ingest_seq")] == [2]


def test_routing_email_skips_location(spark):
    df = posting(spark, [_p(1, "Kiln Fitter", "Oslo", "email"), _p(2, "Kiln Fitter", "Oslo", "lever")])
    out = df.where(filters.routed_rule(TERMS, ["remote"], EXCLUDES))
    assert [r[0] for r in rows(out, "ingest_seq")] == [1]
    assert F is not None
