"""Plan assertions: no query pairs tables by nested loops or cartesian
products; Python runs only in the operators that need it; the scorer runs
after the filters and the anti join."""

import pytest

from lantern.plans import registry
from tests.conftest import SF001

PYTHON_OK = {"S25_safe_name", "W10_unique_name", "S7_message_text", "R20_docx_paragraphs", "M2_apply_scorer", "M6_isolate_failures"}
STREAMING = {"X1_incremental_intake", "X2_late_mail"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_nested_loops_and_python_only_where_needed(spark):
    for name, fn in registry.load_all()[0].items():
        if name in STREAMING:
            continue
        p = _plan(fn(spark, SF001))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name
        if name not in PYTHON_OK:
            assert not any(k in p for k in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow")), name


def test_scorer_runs_after_filters(spark):
    p = _plan(registry.load_all()[0]["M2_apply_scorer"](spark, SF001))
    below = p[p.index("MapInPandas"):]
    assert "Filter" in below and ("Join" in below), "filters and the anti join must feed the scorer"


def test_large_watch_lists_take_the_same_plan(spark):
    """J5 has one path: equi-joins, however long the list."""
    from lantern.operators.watch import watch_table, watchlist_matches
    found = spark.createDataFrame([(1, 1, "Kestrel Tiles Ltd"), (2, 2, "Kes"), (3, 3, "")], "key int, seq int, company string")
    plans = []
    for n in (2, 3000):
        out = watchlist_matches(found, watch_table(spark, ["Kestrel Tiles"] + [f"Name {i}" for i in range(n)]))
        assert sorted(r.key for r in out.collect()) == [1, 2]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
        plans.append(sum(plan.count(k) for k in ("Join",)))
    assert plans[0] == plans[1]


#: The most scans and shuffles of a query's first plan.
BOUNDS = {
    "J4_reply_match": (12, 10), "J8_near_duplicate": (11, 8), "U4_tracker_union": (13, 3), "A4_tracker_totals": (13, 4),
    "T1_tracker_sort": (13, 4), "P16_ready_rows": (13, 3), "A5_role_coverage": (4, 2), "A6_record_coverage": (4, 2),
    "S28_coverage_note": (4, 2), "W6_record_parse": (4, 2), "P21_boilerplate_drop": (8, 6), "A2_source_counts": (8, 6),
    "A10_run_verdict": (3, 4), "R19_run_logs": (2, 2), "K7_brief": (50, 40),
}


def test_tables_are_read_and_shuffled_no_more_than_planned(spark):
    found = {}
    for name in BOUNDS:
        plan = _plan(registry.load_all()[0][name](spark, SF001))
        shuffles = sum(plan.count(f"Exchange {k}") for k in ("hashpartitioning", "rangepartitioning", "SinglePartition", "RoundRobin"))
        found[name] = plan.count("FileScan"), shuffles
    assert {n: f for n, f in found.items() if f[0] > BOUNDS[n][0] or f[1] > BOUNDS[n][1]} == {}


def test_wide_columns_stay_out_of_fan_outs(spark):
    """J5 explodes keys and names, not postings; J4's pairs carry no message."""
    from lantern.operators.watch import watch_table, watchlist_matches
    found = spark.createDataFrame([(1, 1, "Kestrel", "long text")], "key int, seq int, company string, description string")
    out = watchlist_matches(found, watch_table(spark, ["Kestrel Tiles"]))
    assert out.columns == ["key", "seq", "company", "description", "watched"] and out.count() == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    explode = plan[plan.index("Generate explode"):].split("\n")
    assert explode and not any("description" in line for line in explode[:2])


def test_profiles_and_resumes_are_never_broadcast(spark):
    """Entries and canonical employers both grow with the profiles, so neither may
    pass through the driver, however small the estimate."""
    for name in ("J6_canonical_employer", "T6_experience_order"):
        assert "BroadcastExchange" not in _plan(registry.load_all()[0][name](spark, SF001)), name


def test_a_filter_on_the_kind_does_not_repeat_its_patterns(spark):
    """A line's kind is found once, below the filter that keeps some kinds; T4 takes
    its text in one pass over the lines and P21 reads the form once."""
    from lantern.operators import records as R
    qs = registry.load_all()[0]
    items = _plan(qs["W6_record_parse"](spark, SF001))
    assert items.count(R.PLAIN_BULLET) <= 4
    plan = _plan(qs["T4_lens_pick"](spark, SF001))
    assert plan.count("FileScan") <= 4 and "ExistingRDD" not in plan
    assert _plan(qs["P21_boilerplate_drop"](spark, SF001)).count("FileScan") <= 4


def test_odd_employers_keep_their_rows(spark):
    """Entries with the same id share a match, two spellings of one index give two rows,
    an empty name matches, and rows without a key match nothing."""
    from lantern.operators.watch import canonical_match
    e = spark.createDataFrame([(1, 1, "Acme Corp (x)"), (1, 1, "Nobody"), (1, 2, "other"), (1, 3, None), (2, 4, "any"),
                               (1, None, "Acme Corp"), (None, 5, "Acme Corp")], "profile_id long, entry_id long, company string")
    c = spark.createDataFrame([(1, 1, "Acme"), (1, 1, "ACME Corp"), (1, 2, "Beta"), (2, 7, "")], "profile_id long, idx int, company string")
    got = sorted(((r.profile_id, r.entry_id, r.company, r.canon_idx, r.canon_company) for r in canonical_match(e, c).collect()), key=str)
    want = [(1, 1, x, 1, n) for x in ("Acme Corp (x)", "Nobody") for n in ("Acme", "ACME Corp")]
    want += [(1, 3, None, 1, n) for n in ("Acme", "ACME Corp")]  # no name: its empty head is in every canonical
    want += [(1, 2, "other", None, None), (2, 4, "any", 7, ""), (1, None, "Acme Corp", None, None), (None, 5, "Acme Corp", None, None)]
    assert got == sorted(want, key=str)


def test_highlights_are_moved_once(spark):
    """One pass over the highlights; rows that share a place share its hit."""
    from lantern.operators.shape import keep_prefix
    assert _plan(registry.load_all()[0]["J7_keep_prefix"](spark, SF001)).count("FileScan") <= 4
    h = spark.createDataFrame([("a", 0, "Led x"), ("a", 1, "Cut y"), ("a", 1, "Led z"), ("a", None, "Led w"), ("b", 3, "Ran"),
                               ("b", 4, "Ran"), ("c", 2, None), (None, 0, "Led")], "company string, pos int, text string")
    k = spark.createDataFrame([("a", "Led"), ("a", None), ("b", "Nope"), (None, "Led")], "company string, prefix string")
    got = sorted((tuple(r) for r in keep_prefix(h, k).collect()), key=str)
    assert got == sorted([("a", 0, "Led x"), ("a", 1, "Cut y"), ("a", 1, "Led z"), ("b", 3, "Ran"), ("c", 2, None), (None, 0, "Led")], key=str)


def test_vague_bullets_are_searched_once(spark):
    """The pattern of a concrete bullet stands once in the plan."""
    assert _plan(registry.load_all()[0]["S19_style_issues"](spark, SF001)).count("geo-holdout") == 1


def test_dropped_boilerplate_is_the_rest(spark):
    """What is dropped is told in the same pass; rows of no document are told too."""
    from lantern.operators.intake import drop_boilerplate
    p = spark.createDataFrame([(1, 0, "NOTE: Please complete one block per role"), (1, 1, "kept"), (1, 2, None), (None, 3, "kept")],
                              "doc_id long, para_no int, text string")
    assert sorted(r.para_no for r in drop_boilerplate(p, dropped=True).collect()) == [0, 2, 3]
    assert sorted(r.para_no for r in drop_boilerplate(p).collect()) == [1, 3]


def test_reply_pairs_are_scored_where_they_are_made(spark):
    """Messages and applications are dealt out by cell, the pairs never; W4 ships a row per
    message and score."""
    plan = _plan(registry.load_all()[0]["J4_reply_match"](spark, SF001))
    above, below = plan.split("ShuffledHashJoin", 1)
    assert "Exchange" not in above and below.count("REPARTITION_BY_NUM") == 2
    best = _plan(registry.load_all()[0]["W4_best_and_runner_up"](spark, SF001)).split("ShuffledHashJoin", 1)[0]
    assert "Window" not in best and best.count("Exchange") == 2 and "partial_count" in best


def test_odd_mail_and_applications_keep_their_pairs(spark):
    """Texts of one message and rows of one application count as one, a pair named by
    several keys comes once, a message without id gives nothing; W4: a row without number
    comes first."""
    from datetime import datetime as dt

    from lantern.operators.link import best_and_runner_up, reply_candidates
    day = dt(2026, 1, 20)
    m = spark.createDataFrame([(1, "hr@kestrel.com", "", "kestrel tiles glazing role", day), (1, "hr@other.com", "", "nothing else", day),
                               (2, "hr@x.com", "", "kestrel and co", dt(2025, 1, 1)), (None, "hr@kestrel.com", "", "kestrel", day)],
                              "msg_id long, sender string, subject string, body string, date timestamp")
    a = spark.createDataFrame([(7, "Kestrel", "Glazing Role", "https://jobs.lever.co/kestrel-tiles/1", "2026-01-01"),
                               (7, "Kestrel", "Glazing Role", "", "2026-01-01"), (None, "Kestrel", "", "", "2026-01-01"),
                               (8, "Kestrel", "x", "", "not a date")],
                              "row_seq long, company string, title string, url string, date_submitted string")
    found = reply_candidates(m, a)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [(1, 7, 10, True, True), (1, 7, 7, True, True), (1, None, 7, True, True), (1, None, 7, True, True)], key=str)
    none_first = spark.createDataFrame([(1, 4, 7), (1, None, 7), (1, 2, 5), (2, 3, 4)], "msg_id long, row_seq long, score int")
    assert sorted(map(tuple, best_and_runner_up(none_first).collect())) == [(1, None, 7, 7), (2, 3, 4, 0)]


def test_a_script_is_parsed_once(spark):
    """S3: the page is searched for scripts once and its posting's fields are read from one
    node; a document is written as a script after it met its page."""
    plan = _plan(registry.load_all()[0]["S3_jsonld_posting"](spark, SF001))
    assert plan.count(r"application/ld\+json") == 1
    assert "JobPosting" not in plan.split("Join", 1)[1]


def test_landed_documents_share_files(spark):
    """What lands is some files for all documents, not one for each; no id, no
    answer and a repeated id keep their rows."""
    import glob

    from lantern.operators.records import read_record_lines
    from lantern.session import checkpoint_dir
    from lantern.sources.mail import read_mail
    from lantern.sources.packed import write_packed
    top = checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    for name, kind in (("R21_markdown_lines", "records"), ("R20_docx_paragraphs", "forms"), ("S7_message_text", "mail")):
        before = set(glob.glob(f"{top}/{kind}-*"))
        registry.load_all()[0][name](spark, SF001)
        new, = set(glob.glob(f"{top}/{kind}-*")) - before
        assert 0 < len(glob.glob(f"{new}/**/part-*", recursive=True)) <= 20, name
    files = spark.createDataFrame([("a/doc_id=7/r.md", b"x\n\n"), ("doc_id=7/r.md", b"\n"), ("other.md", b"y\r\nz"), (None, b"w\n")], "path string, content binary")
    write_packed(files, f"{top}/packed-records")
    got = sorted(map(tuple, read_record_lines(spark, f"{top}/packed-records", packed=True).collect()), key=str)
    assert got == sorted([("7", 0, "x"), ("7", 1, ""), ("7", 0, ""), ("other.md", 0, "y\r"), ("other.md", 1, "z"), (None, 0, "w")], key=str)
    raw = b"From: a@b.c\r\nSubject: s\r\nContent-Type: text/plain\r\n\r\nbody\r\n"
    write_packed(spark.createDataFrame([("1.eml", raw), ("1.eml", raw)], "path string, content binary"), f"{top}/packed-mail")
    assert [tuple(r) for r in read_mail(spark, f"{top}/packed-mail", packed=True).select("msg_id", "sender", "body").collect()] == [("1.eml", "a@b.c", "body")] * 2


@pytest.mark.parametrize("spread", [0, 1000])
def test_title_tokens_meet_as_numbers_and_score_as_searched(spark, monkeypatch, spread):
    """The points of a title are those of a search for each of its tokens, with repeated,
    very long and stop-word-like ones, keys within keys and several texts; a gram of a message
    is looked up in one cell and a title's tokens are not searched in the text one by one."""
    import random
    from datetime import date
    from datetime import datetime as dt

    from lantern.operators import link
    from lantern.operators.link import reply_candidates
    monkeypatch.setattr(link, "SPREAD", spread)  # 0: the applications of each gram lie in all its blocks
    plan = _plan(registry.load_all()[0]["J4_reply_match"](spark, SF001))
    assert "array_intersect" in plan and "regexp_extract_all" in plan
    rng = random.Random(4)
    words = ["data", "engineer", "lead", "ops", "senior", "x" * 30, "x" * 24, "analyst", "dat", "gine", "abc1"]
    names = ["kest", "kestr", "kestrel", "kestrel tiles", "oakwood", "oakwoodworking"]
    msgs = [(i, f"hr@{rng.choice(names).replace(' ', '')}.com", " ".join(rng.choices(words, k=4)),
             " ".join(rng.choices(words + names, k=9)), None if i % 5 == 0 else dt(2026, 1, 1 + i % 28)) for i in range(40)]
    apps = [(i, rng.choice(names), " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 8]))),
             f"https://jobs.lever.co/{rng.choice(names).replace(' ', '-')}/1", f"2026-01-{1 + i % 28:02d}") for i in range(60)]
    found = reply_candidates(
        spark.createDataFrame(msgs, "msg_id long, sender string, subject string, body string, date timestamp"),
        spark.createDataFrame(apps, "row_seq long, company string, title string, url string, date_submitted string"))
    want = set()
    for mid, sender, subject, body, day in msgs:
        text, host = f"{subject} {body}", sender.split("@")[1].replace(".", "")
        for seq, company, title, url, sent in apps:
            keys = {company.replace(" ", ""), url.split("/")[3].replace("-", "")}
            if day and (day.date() - date.fromisoformat(sent)).days < -2:
                continue
            here, there = any(k in text.replace(" ", "") for k in keys), any(k in host for k in keys)
            toks = title.split()
            hits = sum(t in text for t in toks)
            pts = 0 if not toks else 3 if hits >= max(2, len(toks) // 2) else min(hits, 1)
            if here or there:
                want.add((mid, seq, 4 * here + 3 * there + pts, here, there))
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) > 500 and set(got) == want


def test_rendered_lines_are_sorted_and_told_once(spark):
    """K5: equal lines of a record are found side by side, not by holding each against all
    others, and where its header ends is found once per record."""
    from pyspark.sql import functions as F

    from lantern.functions.predicates import in_order_once
    plan = _plan(registry.load_all()[0]["K5_record_render"](spark, SF001))
    assert "array_distinct" not in plan and "array_union" not in plan and plan.count("sort_array") >= 1
    d = spark.createDataFrame([([(2, "b"), (1, None), (2, "a"), (1, None), (2, "b"), (None, "z"), (None, "z")],), ([],), (None,)],
                              "l array<struct<k:int,t:string>>")
    got = [None if r.o is None else [tuple(x) for x in r.o] for r in d.select(in_order_once(F.col("l")).alias("o")).collect()]
    assert got == [[(None, "z"), (1, None), (2, "a"), (2, "b")], [], None]


def test_intake_lines_are_told_once(spark):
    """K6: equal lines of an intake record are found side by side, as K5's are."""
    plan = registry.load_all()[0]["K6_intake_render"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan and "sort_array" in plan


def test_cells_have_a_partition_each(spark):
    """Dealing out by a cell's name leaves no partition empty and none with two cells."""
    from pyspark.sql import functions as F

    from lantern.operators.link import _cell_names
    names = _cell_names(spark, 64)
    d = spark.createDataFrame([(n,) for n in names], "c int").repartition(64, "c")
    assert sorted(r.p for r in d.select(F.spark_partition_id().alias("p")).collect()) == list(range(64))
