import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import SF, edit_substring

from lantern.llm.decontaminate import Matcher, Pattern, cut, drop_contaminated, find_items, normalise
from lantern.llm.queries import op4_decontamination


@settings(max_examples=300, deadline=None)
@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=60))
def test_myers_distance_against_the_full_matrix(item, text):
    assert Pattern(item).best(text)[0] == edit_substring(item, text)


def edited(text, edits, rng):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at:at + (kind > 0)] = ["q"] * (kind < 2)
    return "".join(out)


def test_every_occurrence_within_the_budget_is_found():
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "omega"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 40)))) for i in range(20)]
    matcher = Matcher(items, 0.05)
    for i, item in items:
        for edits in range(int(0.05 * len(item)) + 4):
            text = "x " * 10 + edited(item, edits, rng) + " y" * 10
            best = edit_substring(item, text)
            got = {k: d for k, d, _ in matcher.find(text)}
            assert (got.get(i) == best) if best <= int(0.05 * len(item)) else (i not in got)


def test_pieces_cover_the_item():
    for n, k in ((1, 0), (10, 3), (241, 12)):
        parts = cut("".join(chr(97 + i % 26) for i in range(n)), k)
        assert len(parts) == k + 1 and sum(len(p) for _, p in parts) == n and all(p for _, p in parts)


def test_whole_table_against_all_items_in_all_documents(spark, documents):
    got = {(r.doc_id, r.item_id): r.distance for r in op4_decontamination(spark, SF).collect()}
    items = {r[0]: normalise(r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {}
    for d, text in documents.items():
        text = normalise(text)
        for i, item in items.items():
            if item in text:
                want[d, i] = 0
            elif len(text) < 1500 and (n := Pattern(item).best(text)[0]) <= int(0.05 * len(item)):
                want[d, i] = n
    assert len(want) > 0 and {k: v for k, v in got.items() if k in want} == want
    assert all(len(documents[d]) >= 1500 for d, _ in set(got) - set(want))


@pytest.fixture
def items(spark):
    rows = [(1, "One two  three four five six seven eight nine ten."), (2, None), (3, "  \n"), (4, "tiny"),
            (5, "one TWO three four five six seven eight nine ten."), (None, "null id item of some length to find")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_awkward_rows(spark, items):
    docs = spark.createDataFrame(
        [(1, "pre one two three\nfour five SIX seven eight nine ten. post", "a"), (2, "one two three four five sax seven eight nine ten.", "b"),
         (3, None, "c"), (4, "", "d"), (None, "a tiny thing", "e"), (6, "t i n y", "f"), (7, "null id item of some length to find", "g"),
         (2, "one two three four five sax seven eight nine ten.", "b"), (8, "z" * 200_000, "h")], "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in find_items(docs, items).collect()), key=str)
    assert got == sorted([(1, 1, 0), (1, 5, 0), (2, 1, 1), (2, 5, 1), (2, 1, 1), (2, 5, 1), (None, 4, 0), (7, None, 0)], key=str)
    left = drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.item_id for r in left.collect()) == ["c", "d", "f", "h"]


def test_blocks_of_items_give_the_same(spark, items):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one, many = (sorted(map(tuple, find_items(docs, bench, block_chars=n).collect())) for n in (4_000_000, 1_500))
    assert one == many and one
    assert drop_contaminated(docs, bench, block_chars=1_500).count() == docs.count() - len({r[0] for r in one})


def test_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert find_items(docs, items.limit(0)).count() == 0 and find_items(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items.limit(0)).count() == 1
