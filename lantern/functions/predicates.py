"""Column-expression builders for literal term lists.

Terms are configuration (tens to hundreds of strings), so they are inlined as
literals: an OR chain of ``contains`` stays inside whole-stage codegen, which a
higher-order ``exists`` over an array literal would not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_false() -> Column:
    return F.lit(False)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def contains_any(text: Column, terms: list[str]) -> Column:
    """True when ``text`` contains any of ``terms`` (plain substring test)."""
    return any_of([text.contains(F.lit(t)) for t in terms])


def first_contained(text: Column, terms: list[str]) -> Column:
    """The first term of ``terms`` (list order) that ``text`` contains, else null."""
    if not terms:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(text.contains(F.lit(t)), F.lit(t)) for t in terms])


def regex_escape(term: str) -> str:
    """Escape every non-alphanumeric character; valid for Java and RE2 alike."""
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in term)


def whole_word(text: Column, word: str) -> Column:
    """``\\bword\\b`` search, Unicode word characters (as Python ``re`` on str)."""
    return text.rlike("(?U)\\b" + regex_escape(word) + "\\b")


def compact(col: Column) -> Column:
    """lower case with everything but a-z and 0-9 removed."""
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def blank_to_null(col: Column) -> Column:
    return F.when(F.trim(col) == "", F.lit(None)).otherwise(col)


#: White space as Python's ``str.split()`` takes it.
SPACES = "(?U)[\\s\\x1c-\\x1f]+"


def one_spaced(col: Column) -> Column:
    """Python ``" ".join(s.split())``; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), SPACES, " "))


def word_count(col: Column) -> Column:
    """Python ``len(s.split())``: the spaces of the text with single spaces, and one for a
    text that is not empty. No branch and no lambda, so the text is made once, in
    generated code."""
    t = one_spaced(col)
    return F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + (t != "").cast("int")


def py_strip(col: Column) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind (Spark's
    ``trim`` removes spaces only)."""
    return F.regexp_replace(col, "(?U)^\\s+|\\s+$", "")


def placeholder_to_empty(col: Column) -> Column:
    """P23 (field form): a value starting with a ``[FILL IN`` marker (any
    case) is unanswered, so it reads as ''."""
    return F.when(F.coalesce(col, F.lit("")).rlike("(?i)^\\[FILL IN"), F.lit("")).otherwise(col)


def has_placeholder(col: Column) -> Column:
    """P23 (check form): the text still carries a ``[FILL IN`` marker."""
    return F.coalesce(col, F.lit("")).contains("[FILL IN")


def bound(value: Column, fn) -> Column:
    """``fn`` of ``value``, which is evaluated once. A step with many patterns goes through
    this: as plain columns they would all land in one generated loop, too long for the JVM to
    compile, which then interprets it row by row."""
    return F.transform(F.array(value), fn)[0]


def in_order_once(lines: Column) -> Column:
    """The different structs of an array, in order. Equal ones lie side by side once sorted:
    ``array_distinct`` would hold each struct against all others."""
    return bound(F.sort_array(lines), lambda s: F.filter(s, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(s, i - 1))))
