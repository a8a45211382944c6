"""Posting filters: title terms, exclusions, location, per-source routing.

All predicates are column expressions so one ``where`` evaluates the whole rule
set in a single codegen'd pass. Term lists are lower-cased here once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.predicates import (any_of, compact, contains_any, first_contained,
                                          whole_word)

# US state names and their postal abbreviations used by the
# location test (27 entries), in the order the rule lists them.
STATE_ABBREV = {
    "pennsylvania": "pa", "new york": "ny", "california": "ca", "texas": "tx",
    "florida": "fl", "illinois": "il", "massachusetts": "ma", "washington": "wa",
    "colorado": "co", "georgia": "ga", "north carolina": "nc", "new jersey": "nj",
    "virginia": "va", "ohio": "oh", "michigan": "mi", "arizona": "az",
    "maryland": "md", "minnesota": "mn", "utah": "ut", "oregon": "or",
    "connecticut": "ct", "delaware": "de", "indiana": "in", "tennessee": "tn",
    "wisconsin": "wi", "missouri": "mo", "nevada": "nv",
}

# A whole-country location that LinkedIn uses for remote roles.
NATIONWIDE = ("united states", "usa", "u.s.", "nationwide", "anywhere")

BILLED_SOURCES = ("linkedin", "indeed")


def _low(terms) -> list[str]:
    return [t.lower() for t in (terms or [])]


def _title(col="title") -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit("")))


def _loc(col="location") -> Column:
    return F.lower(F.coalesce(F.col(col), F.lit("")))


def title_match(keywords, title: str = "title") -> Column:
    """lower(title) contains any keyword. No keywords -> nothing matches."""
    return contains_any(_title(title), _low(keywords))


def title_excluded(excludes, title: str = "title") -> Column:
    """lower(title) contains any exclusion phrase (spaces kept as given)."""
    return contains_any(_title(title), _low(excludes))


def location_match(locations, location: str = "location") -> Column:
    """P3: 'remote' anywhere, or a wanted place as substring, or its state
    abbreviation as a whole word, or a short (<= 3 chars) wanted place as a
    whole word."""
    loc = _loc(location)
    tests = [loc.contains("remote")]
    for want in _low(locations):
        tests.append(loc.contains(F.lit(want)))
        ab = STATE_ABBREV.get(want)
        if ab:
            tests.append(whole_word(loc, ab))
        if len(want) <= 3:
            tests.append(whole_word(loc, want))
    return any_of(tests)


def keyword_rule(keywords, locations, excludes, title: str = "title",
                 location: str = "location") -> Column:
    """P1 and not P2 and (no locations or P3)."""
    rule = title_match(keywords, title)
    if excludes:
        rule = rule & ~title_excluded(excludes, title)
    if locations:
        rule = rule & location_match(locations, location)
    return rule


def keyword_filter(df: DataFrame, keywords, locations, excludes=None) -> DataFrame:
    """P4 as a DataFrame operator."""
    return df.where(keyword_rule(keywords, locations, excludes))


def routed_rule(keywords, locations, excludes, source: str = "source") -> Column:
    """P5: the per-source keep rule as one predicate.

    email: title terms (none given -> pass) minus exclusions, no location test.
    linkedin: P4 without locations, then title says remote, or P3, or a
    nationwide place (no locations -> pass).
    everything else (indeed included): P4.
    """
    kw, ex, locs = _low(keywords), _low(excludes), _low(locations)
    title = _title()
    email_rule = (title_match(kw) if kw else F.lit(True))
    if ex:
        email_rule = email_rule & ~title_excluded(ex)
    if locs:
        wanted = (title.contains("remote") | location_match(locs)
                  | contains_any(_loc(), list(NATIONWIDE)))
    else:
        wanted = F.lit(True)
    linkedin_rule = keyword_rule(kw, [], ex) & wanted
    src = F.col(source)
    return (F.when(src == "email", email_rule)
            .when(src == "linkedin", linkedin_rule)
            .otherwise(keyword_rule(kw, locs, ex)))


def company_block(df: DataFrame, blocked, company: str = "company") -> DataFrame:
    """Drop rows whose compacted company contains a compacted blocked name.

    Compacting is lower case with everything but a-z0-9 removed, on both sides.
    """
    names = [re.sub("[^a-z0-9]", "", b.lower()) for b in (blocked or [])]
    if not names:
        return df
    comp = compact(F.coalesce(F.col(company), F.lit("")))
    return df.where(~contains_any(comp, names))


def drop_reason(keywords, excludes, title: str = "title") -> Column:
    """P7: 'title excluded: <first exclusion in list order>', else
    'no title term matched', else 'location'."""
    ex = _low(excludes)
    hit = first_contained(_title(title), ex)
    return (F.when(hit.isNotNull(), F.concat(F.lit("title excluded: "), hit))
            .when(~title_match(keywords, title), F.lit("no title term matched"))
            .otherwise(F.lit("location")))


def dropped_rows(df: DataFrame, keywords, locations, excludes, run_date: str,
                 sources=BILLED_SOURCES) -> DataFrame:
    """Billed rows their own source rule did not keep, with P7's reason.

    The keep flag is evaluated on the same rows (before role dedupe), so no
    join is needed to take the difference.
    """
    kept = routed_rule(keywords, locations, excludes)
    return (df.where(F.col("source").isin(list(sources)) & ~kept)
            .select(F.lit(run_date).alias("date"), "source",
                    drop_reason(keywords, excludes).alias("reason"),
                    F.coalesce("title", F.lit("")).alias("title"),
                    F.coalesce("company", F.lit("")).alias("company"),
                    F.coalesce("location", F.lit("")).alias("location"),
                    F.coalesce("url", F.lit("")).alias("url"),
                    "ingest_seq"))


def exclusion_impact(df: DataFrame, keywords, locations, excludes) -> DataFrame:
    """How many rows the exclusion list alone removes (one pass)."""
    with_ex = keyword_rule(keywords, locations, excludes)
    without = keyword_rule(keywords, locations, [])
    return df.agg(F.count_if(without).alias("kept_without_exclusions"),
                  F.count_if(with_ex).alias("kept_with_exclusions"),
                  (F.count_if(without) - F.count_if(with_ex)).alias("removed_by_exclusions"))


def sender_filter(df: DataFrame, include=None, exclude=None, sender: str = "sender") -> DataFrame:
    """P10: drop a message whose sender contains any excluded term; with an
    include list the sender must contain one. Terms are lower-cased, the
    sender is compared as written."""
    s = F.coalesce(F.col(sender), F.lit(""))
    rule = F.lit(True)
    if exclude:
        rule = rule & ~contains_any(s, _low(exclude))
    if include:
        rule = rule & contains_any(s, _low(include))
    return df.where(rule)


def posting_passes(df: DataFrame, keywords, locations, excludes) -> DataFrame:
    """P4/P5 over a mixed-source frame: adds boolean ``kept``."""
    return df.withColumn("kept", routed_rule(keywords, locations, excludes))


def any_source(values) -> Column:
    return any_of([F.col("source") == v for v in values])


def dropped_log(old_log: DataFrame, new_drops: DataFrame, run_date: str, keep_days: int = 60) -> DataFrame:
    """K3 + U5: the dropped-postings log after tonight: rows dated on or after
    ``run_date - keep_days`` (text compare on Y-m-d, as stored) plus tonight's
    drops. Written partitioned by date, so pruning is dropping partitions."""
    cutoff = F.date_format(F.date_sub(F.to_date(F.lit(run_date)), keep_days), "yyyy-MM-dd")
    cols = ["date", "source", "reason", "title", "company", "location", "url"]
    kept = old_log.where(F.col("date").isNotNull() & (F.col("date") != "date") & (F.col("date") >= cutoff))
    return kept.select(*cols).unionByName(new_drops.select(*cols))
