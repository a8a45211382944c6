"""J8 against all pairs."""

import random
import re

from lantern.operators.similar import near_duplicates

WORDS = ["".join(random.Random(i).choices("abcdefgh", k=5)) for i in range(60)]


def words(text):
    return set(re.findall("[a-z]{4,}", (text or "").lower()))


def plain(new, titles, lines):
    out = {}
    for i, text in new:
        x = words(text)
        hit = [("accomplishment", k, t) for k, t in titles if x and words(t) and len(x & words(t)) / len(x | words(t)) > 0.5]
        hit = hit or [("bullet", k, (t or "")[:60] + "...") for k, t in lines if words(t) and x and len(x & words(t)) >= max(3, 0.6 * len(x))]
        if hit:
            out[i] = min(hit, key=lambda h: h[1])
    return out


def test_against_all_pairs(spark):
    rng = random.Random(5)
    # a few words are in nearly every text, most are rare
    text = lambda n: " ".join(rng.choice(WORDS[:4] if rng.random() < 0.4 else WORDS) for _ in range(n))
    titles = [(i, text(rng.randint(1, 8))) for i in range(80)] + [(80, None), (81, "")]
    lines = [(i, text(rng.randint(1, 14))) for i in range(120)] + [(120, None)]
    new = [(i, text(rng.randint(1, 10))) for i in range(200)] + [(200, None), (201, "a b c"), (202, titles[3][1].upper())]
    new += [(300 + i, t) for i, t in new[:20]]  # repeated sets
    want = plain(new, titles, lines)
    frames = (spark.createDataFrame(rows, schema) for rows, schema in (
        (new, "new_id long, text string"), (titles, "acc_id long, title string"), (lines, "bullet_id long, text string")))
    got = {r.new_id: (r.kind, r.match_id, r.matched) for r in near_duplicates(*frames).collect()}
    assert got == want
    assert {k for k, _, _ in want.values()} == {"accomplishment", "bullet"} and len(want) < len(new)


def test_empty_sides(spark):
    new = spark.createDataFrame([(1, "alpha beta gamma")], "new_id long, text string")
    titles = spark.createDataFrame([], "acc_id long, title string")
    lines = spark.createDataFrame([], "bullet_id long, text string")
    assert near_duplicates(new, titles, lines).count() == 0
    assert near_duplicates(new.limit(0), spark.createDataFrame([(1, "alpha beta gamma")], "acc_id long, title string"), lines).count() == 0
