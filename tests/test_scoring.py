"""M1: prompts of all kinds over a content-addressed profile part."""

from pyspark.sql import functions as F

from lantern.operators import scoring as S

POSTINGS = [  # id, seq, title, company, location, description, profile
    ("a", 1, "Director", "Acme", "Remote", "<p>Lead. Salary: $170,000 - $200,000 per year {now}</p>", 1),
    ("b", 2, "Analyst", None, None, "Salary: $90k - $110k a year", 1),
    ("c", 3, None, "Globex", "Lyon", None, 2),
    ("d", 4, "No profile", "X", "Y", "text", 9),
]
PROFILES = "profile_id long, name string, years_experience string, positioning_notes string, publications array<string>"


def tables(spark):
    postings = spark.createDataFrame(POSTINGS, "posting_id string, ingest_seq long, title string, company string, location string, "
                                     "description_html string, profile_id long")
    profiles = spark.createDataFrame([(1, "Ann É", "12 years", "Keep {it} short", ["A paper"]), (2, "Bo", None, None, [])], PROFILES)
    return postings, profiles


def test_kinds_fields_and_rules(spark):
    rows = {(r.posting_id, r.kind): r for r in S.prompt_table(*tables(spark)).collect()}
    assert sorted(rows) == sorted((p, k.name) for p in "abc" for k in S.KINDS)
    a = rows["a", "score"].posting_part
    assert a.startswith("\nJOB POSTING:\nTitle: Director\nCompany: Acme\nLocation: Remote\nDescription:  Lead. Salary: $170,000 - $200,000 per year {now} \n")
    assert "$170,000 to $200,000; pay at this level" in a and '{"score": 0' in a
    assert "$90,000 to $110,000; weigh 12 years experience" in rows["b", "score"].posting_part
    assert "Company: \nLocation: \n" in rows["b", "score"].posting_part
    assert "no pay is stated; with many years of experience" in rows["c", "score"].posting_part
    for kind in ("resume", "letter"):
        assert "Location" not in rows["a", kind].posting_part
        assert "- Keep {it} short" in rows["a", kind].posting_part
    assert S.PUBLICATIONS in rows["a", "letter"].posting_part
    assert "publications" not in rows["c", "letter"].posting_part


def test_prefix_is_one_text_per_profile_and_kind(spark):
    postings, profiles = tables(spark)
    parts = S.prompt_table(postings, profiles)
    refs = {(r.posting_id, r.kind): r.prefix_id for r in parts.collect()}
    assert refs["a", "score"] == refs["b", "score"] != refs["c", "score"]
    assert len({refs["a", k.name] for k in S.KINDS}) == 3
    prefixes = S.profile_prefixes(profiles)
    one = prefixes.where("profile_id = 1 AND kind = 'score'").first()
    assert one.prefix == ('Judge how well a job posting fits this candidate.\n\nCANDIDATE PROFILE:\n{"name":"Ann É","years_experience":"12 years",'
                          '"positioning_notes":"Keep {it} short","publications":["A paper"]}\n')
    again = S.profile_prefixes(profiles.unionByName(profiles.withColumn("profile_id", F.lit(7).cast("long") + F.col("profile_id"))))
    assert S.stored_prefixes(again).count() == S.stored_prefixes(prefixes).count() == 6
    whole = S.full_prompts(parts, prefixes).where("posting_id = 'a' AND kind = 'score'").first().prompt
    assert whole.startswith(one.prefix + "\nJOB POSTING:\nTitle: Director")


def test_text_cut_is_a_choice_and_pay_is_read_from_all_of_it(spark):
    postings, profiles = tables(spark)
    long = postings.where("posting_id = 'a'").withColumn("description_html", F.concat(F.lit("x" * 5000), F.lit(" salary $170,000 - $200,000")))
    whole, cut = (S.prompt_table(long, profiles, max_chars=n).where("kind = 'score'").first().posting_part for n in (None, 4000))
    assert "x" * 5000 in whole and "x" * 4001 not in cut
    assert "$170,000 to $200,000" in cut
