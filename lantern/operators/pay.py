"""Pay extraction.

S10 needs every match of the range pattern together with the text around it
(60 characters before, 30 after). Spark's regex functions give matches but not
positions, so each match is wrapped in two marker characters with one
``regexp_replace``; splitting on the opening marker turns the text into
"before the first match" plus one "match<end marker>text up to the next match"
piece per match; the context windows come from the ends of the pieces next to it. Everything
stays in the JVM; the per-match decisions are array higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pay range pattern and the context patterns around it.
SALARY_RANGE = (r"\$\s?(\d{2,3}(?:,\d{3})?(?:\.\d+)?)\s?([kK])?"
                r"(?:\s*/\s*(yr|year|hr|hour|mo|month))?"
                r"\s*(?:-|–|—|to)\s*\$?\s?"
                r"(\d{2,3}(?:,\d{3})?(?:\.\d+)?)\s?([kK])?")
RATE_TRAILING = r"per\s+hour|hourly|an\s+hour|/\s?h(?:r|our)|\bp/?h\b"
ANNUAL_TRAILING = r"/\s?yr|per year|per annum|annually|a year|usd"
PAY_CONTEXT = r"salar|compensat|\bpay\b|annual|total target|earn"
SALARY_FLOOR = 160000
OPEN, CLOSE = "\u0001", "\u0002"
# Characters looked at before and after a match, and of the shortest match ("$10-20").
LEADING, TRAILING, LEAST = 60, 30, 6


def _num(g: Column) -> Column:
    return F.regexp_replace(g, ",", "").cast("double")


def salary_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """All plausible annual ranges of each row's ``text``, in text order, as
    ``_cands: array<struct<in_context, low, high>>`` (helper of S10).

    A match is at least ``LEAST`` characters, so the 60 before it lie in the 10 pieces
    before it and the 30 after it in its own and the 5 pieces after: each match reads a
    fixed number of neighbours' ends, and a text costs in proportion to its length."""
    t = F.coalesce(F.col(text), F.lit(""))
    # the markers must not occur in the text itself
    clean = F.regexp_replace(t, f"[{OPEN}{CLOSE}]", "")
    pat = "(?U)" + SALARY_RANGE
    segs = F.split(F.regexp_replace(clean, pat, f"{OPEN}$0{CLOSE}"), OPEN)
    plain = lambda x: F.replace(x, F.lit(CLOSE), F.lit(""))

    def one(ends, seg, i):
        """``seg`` is piece i + 1; its match, and what stands next to it."""
        m = F.substring_index(seg, CLOSE, 1)
        first = F.greatest(i + 2 - LEADING // LEAST, F.lit(1))
        leading = F.right(F.array_join(F.slice(ends["tails"], first, i + 2 - first), ""), F.lit(LEADING))
        trailing = F.left(F.concat(F.left(F.substring_index(seg, CLOSE, -1), F.lit(TRAILING)),
                                   F.array_join(F.slice(ends["heads"], i + 3, F.lit(TRAILING // LEAST)), "")), F.lit(TRAILING))
        unit = F.lower(F.regexp_extract(m, pat, 3))
        g1, g4 = F.regexp_extract(m, pat, 1), F.regexp_extract(m, pat, 4)
        k1, k5 = F.regexp_extract(m, pat, 2), F.regexp_extract(m, pat, 5)
        raw_low, raw_high = _num(g1), _num(g4)
        cents = g1.contains(".") | g4.contains(".")

        def val(raw, k):
            return F.when((k != "") | (raw < 1000), (raw * 1000).cast("long")).otherwise(raw.cast("long"))
        low, high = val(raw_low, k1), val(raw_high, k5)
        keep = (~(unit.startswith("hr") | unit.startswith("hour") | unit.startswith("mo")
                  | unit.startswith("month"))
                & ~trailing.rlike("(?iU)" + RATE_TRAILING)
                & ~(cents & ((raw_low < 1000) | (raw_high < 1000)))
                & ~((low > high) | (high < 30000) | (high > 2000000)))
        in_ctx = (unit.startswith("yr") | unit.startswith("year")
                  | leading.rlike("(?iU)" + PAY_CONTEXT) | trailing.rlike("(?iU)" + ANNUAL_TRAILING))
        return F.when(keep, F.struct(in_ctx.alias("in_context"), low.alias("low"), high.alias("high")))

    # bound one after the other by lambdas, so that the pieces are made once for a text
    ends = F.transform(F.array(segs), lambda s: F.struct(
        s.alias("segs"), F.transform(s, lambda x: F.right(plain(x), F.lit(LEADING))).alias("tails"),
        F.transform(s, lambda x: F.left(plain(x), F.lit(TRAILING))).alias("heads")))
    cands = F.transform(ends, lambda e: F.array_compact(F.transform(
        F.slice(e["segs"], F.lit(2), F.size(e["segs"])), lambda seg, i: one(e, seg, i))))[0]
    return df.withColumn("_cands", cands)


def salary_range(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``salary_low`` / ``salary_high``: the first plausible annual
    range stated in a pay context, else the first plausible range, else null.
    Hourly and monthly figures, small amounts with cents, and pairs outside
    30k-2M are not salaries; 'k' and bare hundreds mean thousands."""
    d = salary_candidates(df, text)
    first_ctx = F.get(F.filter("_cands", lambda c: c["in_context"]), 0)
    pick = F.coalesce(first_ctx, F.get(F.col("_cands"), 0))
    return (d.withColumn("_pick", pick)
            .withColumn("salary_low", F.col("_pick.low"))
            .withColumn("salary_high", F.col("_pick.high"))
            .drop("_cands", "_pick"))


# --- S11: pay objects --------------------------------------------------------

_NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE", "BOOLEAN")


def _is_number(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return t.isin(*_NUMERIC) | t.startswith("DECIMAL")


def pay_object(col) -> Column:
    """(low, high, unit) of a flat or schema.org-nested pay object (JSON
    text), or null when it is not an object or either end is not a number.
    An explicit ``min`` key wins over ``minValue`` even when it is null."""
    v = F.try_parse_json(col if isinstance(col, Column) else F.col(col))
    is_obj = F.schema_of_variant(v).startswith("OBJECT")
    val = F.try_variant_get(v, "$.value", "variant")
    inner = F.when(F.coalesce(F.schema_of_variant(val).startswith("OBJECT"), F.lit(False)), val).otherwise(v)

    def get(a, b):
        x = F.try_variant_get(inner, f"$.{a}", "variant")
        return F.when(x.isNotNull(), x).otherwise(F.try_variant_get(inner, f"$.{b}", "variant"))

    def truthy(path, on):
        s = F.try_variant_get(on, path, "string")
        return F.when(s.isNotNull() & (s != "") & (s != "0") & (s != "false"), s)

    low, high = get("min", "minValue"), get("max", "maxValue")
    unit = F.coalesce(truthy("$.unitOfWork", inner), truthy("$.unitText", inner),
                      truthy("$.unitOfWork", v), F.lit("YEAR"))
    ok = is_obj & F.coalesce(_is_number(low), F.lit(False)) & F.coalesce(_is_number(high), F.lit(False))
    return F.when(ok, F.struct(
        F.variant_get(low, "$", "double").cast("long").alias("low"),
        F.variant_get(high, "$", "double").cast("long").alias("high"),
        F.lower(unit).alias("unit")))


def pay_line(pay: Column) -> Column:
    """The 'Salary: $a - $b per unit' line R13 prepends (thousands separated)."""
    return F.when(pay.isNotNull(), F.concat(
        F.lit("Salary: $"), F.format_number(pay["low"], 0), F.lit(" - $"),
        F.format_number(pay["high"], 0), F.lit(" per "), pay["unit"]))


# --- S13 ----------------------------------------------------------------------

def seniority(low: str = "salary_low", high: str = "salary_high", floor: int = SALARY_FLOOR):
    """Which seniority instruction applies (no pay / below the floor /
    at or above it) and whether the overqualification flag is forced off."""
    h = F.col(high)
    rule = (F.when(h.isNull(), F.lit("no pay stated"))
            .when(h >= floor, F.lit("at or above floor")).otherwise(F.lit("below floor")))
    return rule, F.coalesce(h >= floor, F.lit(False))
