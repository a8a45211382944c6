from plain import SF, drop_lines

from lantern.llm.line_dedup import drop_common_lines, frequent_keys


def test_whole_table_against_plain_statement(spark, documents):
    out = drop_common_lines(spark.read.parquet(f"{SF}/documents.parquet"), min_docs=10)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in out.collect()}
    want = drop_lines(documents, 10)
    assert got == want
    assert sum(w[1] for w in want.values()) > 0


def test_awkward_rows(awkward):
    out = drop_common_lines(awkward, min_docs=3)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == 11
    got = {r.key: (r.n_lines, r.n_dropped, r.text) for r in rows}
    # "alpha beta" and "gamma" are in four rows, a null id and a repeated row among them
    assert [got[k] for k in (0, 2, 4, 5)] == [(2, 2, "")] * 4
    assert got[1] == got[3] == (1, 0, "")
    assert got[6] == (3, 0, " \t \n\n")
    assert got[8] == (1, 0, "x" * 70_000)


def test_line_twice_in_a_document_counts_once(spark):
    df = spark.createDataFrame([(1, "a\nb\na"), (2, "A \nc")], "doc_id long, text string")
    assert {(r.h1, r.h2) for r in frequent_keys(df, min_docs=3).collect()} == set()
    assert {r.doc_id: r.text for r in drop_common_lines(df, min_docs=2).collect()} == {1: "b", 2: "c"}


def test_blank_lines_and_empty_table(spark, awkward):
    df = spark.createDataFrame([(1, "a\n\nb"), (2, "c\n \nd")], "doc_id long, text string")
    assert {r.text for r in drop_common_lines(df, min_docs=2, min_chars=0).collect()} == {"a\nb", "c\nd"}
    assert drop_common_lines(awkward.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    plan = drop_common_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
