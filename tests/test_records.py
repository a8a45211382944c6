"""Record parsing (W6), coverage (A5/A6/S28), lookup (J10), lens (T4) and
render (K5) on a literal record; render(parse(x)) is a fixed point."""

from pyspark.sql import functions as F

from lantern.operators import records as R
from tests.conftest import rows

SAMPLE = """# Accomplishment record

Imported from a form on 2026-01-01.

## Contact

- **Name:** Sam Rivera
- **Email:** sam@example.org

## Positioning

### Core competencies

- Forecasting
- Team building

### What sets me apart

Turns messy data into decisions.

## Roles

### Harbor Foods — Head of Insight

- **Dates:** 2020 - Present
- **Authority:** 6 analysts
- **Reported to:** COO
- **Markets:** [FILL IN: markets]

> Added by hand after the form.

#### Price test programme

- **Problem:** Margins had slipped 3 points.
- **Actions:** Ran store-level price tests.
- **Results:** Margin back up 2 points.
- **Evidence:** metric
a wrapped second line that the format drops

#### Recorded resume bullets

From a finished resume, so each one is already compressed.

- Built the forecasting team from scratch
- Hired and coached three analysts

### Lark & Co -- Analyst

- **Dates:** 2015 - 2020

#### Weekly reporting

- **Problem:** [FILL IN]
- **Results:** Reports out a day earlier.

## Peer comments

- "Sam made the numbers make sense."
"""


def lines_df(spark, text, doc="d1"):
    return spark.createDataFrame([(doc, i, ln) for i, ln in enumerate(text.split("\n"))],
                                 "doc_id string, line_no int, line string")


def test_parse_pieces(spark):
    items = R.parse_record(lines_df(spark, SAMPLE))
    got = {}
    for r in items.collect():
        got.setdefault(r.kind, []).append((r.label, r.text) if r.label else (r.employer or r.text))
    assert got["contact"] == [("Name", "Sam Rivera"), ("Email", "sam@example.org")]
    assert got["competency"] == ["Forecasting", "Team building"]
    assert got["sets_apart"] == ["Turns messy data into decisions."]
    assert got["role"] == ["Harbor Foods", "Lark & Co"]
    assert ("Markets", "") in got["role_field"]
    assert got["note"] == ["Added by hand after the form."]
    assert got["accomplishment"] == ["Price test programme", "Weekly reporting"]
    assert got["bullet"] == ["Built the forecasting team from scratch", "Hired and coached three analysts"]
    assert ("Problem", "") in got["acc_field"]
    assert got["trailing"][0] == "## Peer comments"
    dropped = rows(R.dropped_lines(lines_df(spark, SAMPLE)), "line")
    assert ("a wrapped second line that the format drops",) in dropped


def test_coverage_and_note(spark):
    items = R.parse_record(lines_df(spark, SAMPLE))
    cov = R.thinnest_first(R.role_coverage(items))
    got = sorted(rows(cov.select("employer", "accomplishments", "quantified", "bullets", "total", "need_rank",
                                 R.coverage_note().alias("n"))))
    assert got == [("Harbor Foods", 1, 1, 2, 3, 2, "3 recorded, 2 from a resume only, 1 with a number"),
                   ("Lark & Co", 1, 0, 0, 1, 1, "1 recorded, 0 with a number")]


def test_role_lookup_ignores_punctuation(spark):
    items = R.parse_record(lines_df(spark, SAMPLE))
    wanted = spark.createDataFrame([("d1", "lark and co"), ("d1", "LARK-&-CO"), ("d1", "harbor foods")],
                                   "doc_id string, employer string")
    got = sorted(rows(R.role_lookup(R.roles_table(items), wanted), "employer", "role_employer"))
    assert got == [("LARK-&-CO", "Lark & Co"), ("harbor foods", "Harbor Foods")]


def test_lens_is_least_covered(spark):
    items = R.parse_record(lines_df(spark, SAMPLE))
    lens = dict(rows(R.pick_lens(R.role_text(items)).join(R.roles_table(items), ["doc_id", "role_line"])
                     .select("employer", "lens")))
    assert lens["Harbor Foods"] == "fixing"


def test_render_is_a_fixed_point(spark):
    once = rows(R.render_record(R.parse_record(lines_df(spark, SAMPLE))), "markdown")[0][0]
    twice = rows(R.render_record(R.parse_record(lines_df(spark, once))), "markdown")[0][0]
    assert once == twice
    assert "- **Markets:**" not in once
    assert "- **Problem:** [FILL IN]" in once
    assert once.index("### Harbor Foods — Head of Insight") < once.index("#### Recorded resume bullets")
    assert once.endswith('- "Sam made the numbers make sense."\n')
    assert F is not None
