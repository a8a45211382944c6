"""Batch scoring surface (M1-M7): the Spark work around an injected scorer."""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions.text import json_candidates, strip_html
from lantern.operators.pay import salary_range, seniority


def resolve_attempts(responses: DataFrame, max_attempts: int = 2) -> DataFrame:
    """M3: per item, attempts in order (only the first ``max_attempts``): a
    truncated answer fails the item and is not retried; the first answer that
    parses (as is, or after the S24 repair) wins; otherwise the item fails
    with 'did not parse'. One partial/final aggregate per item."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "(?U)^\\s+|\\s+$", "")
    cut, repaired = json_candidates(text)
    ok_cut = F.try_parse_json(cut).isNotNull()
    ok_rep = F.try_parse_json(repaired).isNotNull()
    r = (responses.where(F.col("attempt") < max_attempts)
         .withColumn("truncated", F.col("stop_reason") == "max_tokens")
         .withColumn("parsed", ~F.col("truncated") & (ok_cut | ok_rep))
         .withColumn("json", F.when(ok_cut, cut).otherwise(repaired)))
    decisive = F.col("truncated") | F.col("parsed")
    per = r.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("attempts_made"),
        F.min_by(F.struct("attempt", "truncated", "json"), F.when(decisive, F.col("attempt"))).alias("d"))
    status = (F.when(F.col("d").isNull(), F.lit("failed"))
              .when(F.col("d.truncated"), F.lit("failed")).otherwise(F.lit("ok")))
    reason = (F.when(F.col("d").isNull(), F.lit("did not parse"))
              .when(F.col("d.truncated"), F.lit("truncated at max_tokens")))
    return per.select("item_id", status.alias("status"), reason.alias("reason"),
                      F.when(status == "ok", F.col("d.attempt")).alias("attempt"),
                      F.when(status == "ok", F.col("d.json")).alias("json"))


def next_round(items: DataFrame, resolved: DataFrame, key: str = "item_id") -> DataFrame:
    """M3: items still to ask in the next round (no successful answer yet)."""
    return items.join(resolved.where(F.col("status") == "ok").select(key), key, "left_anti")


class KeyRefused(Exception):
    """Raised by a scorer whose service refuses its key: no later call can do better."""


def apply_scorer(postings: DataFrame, scorer, schema: str, key: str = "posting_id") -> DataFrame:
    """M2 and M6: run an injected ``fn(pandas.DataFrame) -> pandas.DataFrame`` over the
    rows with ``mapInPandas``. Filters belong before this call: Catalyst cannot push them
    through the Python stage. ``schema`` needs ``key`` and ``error string``.

    A batch whose call raises is tried row by row; a row that raises again is returned
    with its ``error``, and the others with their scores. After ``KeyRefused`` a task
    calls the scorer no more: its remaining rows come back with ``error`` 'refused: ...',
    so ``refused`` tells the caller to stop the run, and what was scored is kept."""
    import pandas as pd
    from pyspark.sql.types import _parse_datatype_string

    def run(batches):
        refused = None

        def failed(rows, why):
            out = pd.DataFrame({name: [None] * len(rows) for name in names})
            out[key], out["error"] = rows[key].to_numpy(), why
            return out

        for b in batches:
            if refused is None:
                try:
                    yield scorer(b)
                    continue
                except KeyRefused as exc:
                    refused = f"refused: {exc}"
                except Exception:
                    for i in range(len(b)):
                        row = b.iloc[i:i + 1]
                        if refused is None:
                            try:
                                yield scorer(row)
                                continue
                            except KeyRefused as exc:
                                refused = f"refused: {exc}"
                            except Exception as exc:
                                yield failed(row, f"{type(exc).__name__}: {exc}")
                                continue
                        yield failed(row, refused)
                    continue
            yield failed(b, refused)

    names = _parse_datatype_string(schema).names
    return postings.mapInPandas(run, schema=schema)


def refused(scored: DataFrame) -> DataFrame:
    """Rows not scored because the service refused the key."""
    return scored.where(F.col("error").startswith("refused: "))


@dataclass(frozen=True)
class PromptKind:
    """One kind of prompt. ``lead`` opens the profile part, which is the same for every
    posting; ``fields`` are the posting's columns shown, by label; ``rest`` follows them,
    with the slots ``{seniority}``, ``{positioning}`` and ``{publications}`` filled per
    posting or profile (``{{`` and ``}}`` are braces)."""
    name: str
    lead: str
    fields: tuple[tuple[str, str], ...]
    rest: str


_SHOWN = (("Title", "title"), ("Company", "company"))
_PLACED = (*_SHOWN, ("Location", "location"))

SCORE = PromptKind("score", "Judge how well a job posting fits this candidate.", _PLACED, """
Give the fit from 0 to 10 for:
- skills and experience
- {seniority}
- place of work
Requirements on which the profile is silent are to be confirmed, not counted against the fit.
Answer with this JSON alone:
{{"score": 0, "reasoning": "", "overqualification_risk": false}}
""")
RESUME = PromptKind("resume", "Write this candidate's resume for a job posting.", _SHOWN, """
- Use the posting's own words where they are true of the candidate.
- {positioning}
- State only employers, titles and figures that the profile holds; mark PLACEHOLDER fields [FILL IN: ...].
- Roles go from the latest to the earliest; within a role, what the posting asks for goes first.
""")
LETTER = PromptKind("letter", "Write this candidate's cover letter for a job posting.", _SHOWN, """
- Three groups of achievements, each under a header taken from the posting.
- Highlights are the only source of achievements; a figure that the profile does not hold may not appear.
- {positioning}{publications}
- Mark PLACEHOLDER fields [FILL IN: ...].
""")
KINDS = (SCORE, RESUME, LETTER)
PUBLICATIONS = "\n- The profile lists publications; one may support a point in a clause."


def profile_prefixes(profiles: DataFrame, kinds=KINDS) -> DataFrame:
    """The stable part of every prompt, content-addressed: ``profile_id``, ``kind``,
    ``prefix_id`` (SHA-256 of the text) and ``prefix`` (the kind's lead and the whole
    profile as JSON, keys in column order). ``profiles``: ``profile_id`` and the profile's
    columns. No posting is read, so a profile's prefix is one text however many postings
    refer to it, and a cache keyed by ``prefix_id`` is hit by all but the first."""
    shown = F.to_json(F.struct(*[c for c in profiles.columns if c != "profile_id"]), {"ignoreNullFields": "false"})
    leads = F.array(*[F.struct(F.lit(k.name).alias("kind"), F.lit(k.lead).alias("lead")) for k in kinds])
    each = profiles.select("profile_id", shown.alias("_json"), F.inline(leads))
    prefix = F.concat("lead", F.lit("\n\nCANDIDATE PROFILE:\n"), "_json", F.lit("\n"))
    return each.select("profile_id", "kind", F.sha2(prefix, 256).alias("prefix_id"), prefix.alias("prefix"))


def stored_prefixes(prefixes: DataFrame) -> DataFrame:
    """One row per distinct text: ``prefix_id``, ``prefix``."""
    return prefixes.groupBy("prefix_id").agg(F.first("prefix").alias("prefix"))


def _seniority(years: Column) -> Column:
    """S13 in words: what the stated pay says about a candidate with ``years``."""
    pay = F.concat(F.lit("seniority: the posting states $"), F.format_number("salary_low", 0), F.lit(" to $"), F.format_number("salary_high", 0))
    rule, _ = seniority()
    years = F.coalesce(F.when(years != "", years), F.lit("many years of"))
    return (F.when(rule == "at or above floor", F.concat(pay, F.lit(
                "; pay at this level asks for deep experience, so overqualification does not lower the fit and its flag is false")))
            .when(rule == "below floor", F.concat(pay, F.lit("; weigh "), years, F.lit(
                " experience against it and flag overqualification for contributor or manager roles")))
            .otherwise(F.concat(F.lit("seniority: no pay is stated; with "), years, F.lit(
                " experience flag overqualification where it applies"))))


def _filled(template: str, slots: dict[str, Column]) -> Column:
    parts = []
    for literal, slot, _, _ in Formatter().parse(template):
        parts += [F.lit(literal)] if literal else []
        parts += [slots[slot]] if slot else []
    return F.concat(*parts)


def prompt_table(postings: DataFrame, profiles: DataFrame, kinds=KINDS, max_chars: int | None = None) -> DataFrame:
    """M1: one row per posting and kind: ``posting_id``, ``ingest_seq``, ``kind``,
    ``prefix_id`` (see ``profile_prefixes``) and ``posting_part``, what follows the prefix.
    ``postings`` name their ``profile_id``; one without a known profile has no prompt.

    A posting's text is cleaned and searched for pay once and then fanned out to its
    kinds; profiles lend it only years, notes and a flag, never their text. The pay is
    looked for in the whole description; the prompt shows all of it, or its first
    ``max_chars`` characters."""
    lent = profiles.select("profile_id", F.col("years_experience").cast("string").alias("_years"),
                           F.coalesce("positioning_notes", F.lit("")).alias("_notes"),
                           (F.coalesce(F.size("publications"), F.lit(0)) > 0).alias("_published"))
    refs = profile_prefixes(profiles, kinds).groupBy("profile_id").agg(
        F.map_from_entries(F.collect_list(F.struct("kind", "prefix_id"))).alias("_refs"))
    read = salary_range(postings.withColumn("_text", strip_html(F.col("description_html"))), "_text")
    read = read.join(lent, "profile_id").join(refs, "profile_id").withColumn("_rule", _seniority(F.col("_years")))
    shown = F.col("_text") if max_chars is None else F.substring("_text", 1, max_chars)
    slots = {"seniority": F.col("_rule"), "positioning": F.col("_notes"),
             "publications": F.when(F.col("_published"), F.lit(PUBLICATIONS)).otherwise("")}

    def part(kind: PromptKind) -> Column:
        head = [x for label, c in kind.fields for x in (F.lit(f"\n{label}: "), F.coalesce(c, F.lit("")))]
        return F.concat(F.lit("\nJOB POSTING:"), *head, F.lit("\nDescription: "), shown, F.lit("\n"), _filled(kind.rest, slots))

    fan = F.inline(F.array(*[F.struct(F.lit(k.name).alias("kind"), part(k).alias("posting_part")) for k in kinds]))
    return read.select("posting_id", "ingest_seq", "_refs", fan).select(
        "posting_id", "ingest_seq", "kind", F.col("_refs")[F.col("kind")].alias("prefix_id"), "posting_part")


def full_prompts(parts: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Whole prompts, for a service without a prefix cache: parts joined to their text."""
    return parts.join(stored_prefixes(prefixes), "prefix_id").select(
        "posting_id", "ingest_seq", "kind", F.concat("prefix", "posting_part").alias("prompt"))


def fixed_fields(letters: DataFrame, positioning: str, lead_in: str, closing: str) -> DataFrame:
    """M5: the letter's fixed paragraphs overwritten from configuration, and
    name and contact from the profile (``name``, ``email``, ``phone``
    columns), on the ``letter`` struct."""
    return letters.withColumn("letter", F.col("letter")
                              .withField("positioning", F.lit(positioning))
                              .withField("lead_in", F.lit(lead_in))
                              .withField("closing_para", F.lit(closing))
                              .withField("name", F.coalesce(F.col("name"), F.lit("")))
                              .withField("contact", F.concat(F.coalesce("email", F.lit("")), F.lit("\n"),
                                                             F.coalesce("phone", F.lit("")))))


def split_failures(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M6: rows the scorer could not score go to a failures table; one bad
    row never fails the batch. A refused key is the one failure that stops the
    run (see ``refused``)."""
    return scored.where(F.col("error").isNull()), scored.where(F.col("error").isNotNull())


def lint_rounds(bullets: DataFrame, profiles: DataFrame, letters: DataFrame, rewrite, extra_tells=None) -> DataFrame:
    """M4: lint the drafts (A13); drafts with problems get one corrective round and are
    linted again. ``rewrite(redo)`` takes those letters (``letter_id``, ``problems``) and
    returns their new (bullets, letters). The result keeps every letter with its round
    count and any problems left."""
    from lantern.operators.lint import lint_summary
    from lantern.session import cut_lineage
    # written once: the redone letters are chosen and rewritten from it (a model call stands
    # between the rounds), and the second round lints those alone
    first = cut_lineage(lint_summary(bullets, profiles, letters, extra_tells))
    bullets, letters = rewrite(first.where(~F.col("clean")).select("letter_id", "problems"))
    again = lint_summary(bullets, profiles, letters, extra_tells)
    done = first.where(F.col("clean")).select("letter_id", F.lit(1).alias("rounds"), "problems", "clean")
    return done.unionByName(again.select("letter_id", F.lit(2).alias("rounds"), "problems", "clean"))
