"""Text extraction as column expressions.

Everything is ``regexp_replace`` / ``regexp_extract`` / ``replace`` chains in
the JVM. Java regexes take the back-references and look-behinds these rules
use; ``(?U)`` gives Python's Unicode ``\\w \\b \\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions.predicates import bound, py_strip

# The HTML entities decoded in page text, in decoding order.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]

BLOCK_TAGS = r"(?is)<(script|style|nav|header|footer)[^>]*>.*?</\1>"
BLOCK_ENDS = r"(?is)<br\s*/?>|</p>|</div>|</li>"
JSONLD_SCRIPT = r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"
TITLE_TAG = r"(?is)<title[^>]*>(.*?)</title>"
NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
GREENHOUSE_URL = r"greenhouse\.io/(?:embed/job_app\?for=)?([^/?]+)/jobs/(\d+)"
URL_IN_TEXT = r"https?://[^\s\"'>)\]]+"
REAL_BOARD = (r"(?i)(greenhouse\.io|lever\.co|ashbyhq\.com|myworkdayjobs\.com|smartrecruiters\.com|"
              r"workable\.com|icims\.com|taleo\.net|oraclecloud\.com|successfactors|jobvite\.com|"
              r"careers?\.[a-z0-9-]+\.[a-z]{2,})")
# Subjects that are about an application already sent.
APPLICATION_SUBJECT = [
    r"thank(?:s| you) for (?:applying|your application)",
    r"thank(?:s| you) for (?:your )?interest in",
    r"\byour\b(?:\s+\S+){0,4}\s+application\b",
    r"\bapplication\b[^.]{0,20}\b(?:received|submitted|confirmation|status|update)\b",
    r"\bapplication (?:to|for|with)\b",
    r"\binterview\b[^.]{0,30}\b(?:confirmation|invitation|invite|scheduled|scheduling|reminder|availability)\b",
    r"\b(?:schedul\w+|confirm\w*|reschedul\w+|invitation|invite) (?:your |the |an |a )?(?:\w+ ){0,2}interview\b",
    r"thank(?:s| you) for (?:the|your|our) (?:call|time|conversation|chat|meeting|discussion)",
]
ALERT_HIRING = r"(?i)^(.+?)\s+is hiring an?\s+(.+)$"
ALERT_AT = r"(?i)^(.+?)\s+at\s+([^:]+?)(?::.*)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _replace(col: Column, a: str, b: str) -> Column:
    return F.replace(col, F.lit(a), F.lit(b))


def strip_html(html) -> Column:
    """Every tag becomes a space."""
    return F.regexp_replace(F.coalesce(_c(html), F.lit("")), "<[^<]+?>", " ")


def page_text(html) -> Column:
    """Drop script/style/nav/header/footer blocks, block ends become
    newlines, other tags spaces, six entities decoded (in order), runs of
    spaces/tabs collapsed, 3+ newlines cut to 2, stripped."""
    t = F.regexp_replace(F.coalesce(_c(html), F.lit("")), BLOCK_TAGS, " ")
    t = F.regexp_replace(t, BLOCK_ENDS, "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for a, b in ENTITIES:
        t = _replace(t, a, b)
    t = F.regexp_replace(t, "[ \\t]+", " ")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return py_strip(t)


def page_title(html, default: str = "[FILL IN: title]") -> Column:
    """S4 title: <title> text, cut at the first '|' and then at ' at '."""
    t = py_strip(F.regexp_extract(F.coalesce(_c(html), F.lit("")), TITLE_TAG, 1))
    t = py_strip(F.split_part(F.split_part(t, F.lit("|"), F.lit(1)), F.lit(" at "), F.lit(1)))
    return F.when(t == "", F.lit(default)).otherwise(t)


def url_host_label(url) -> Column:
    """S4 company: the url's host with 'www.' removed, up to its first dot."""
    netloc = F.regexp_extract(F.coalesce(_c(url), F.lit("")), NETLOC, 1)
    return F.split_part(_replace(netloc, "www.", ""), F.lit("."), F.lit(1))


def greenhouse_board(url) -> tuple[Column, Column]:
    """(board token, job id) of a Greenhouse url, '' when not one."""
    u = F.coalesce(_c(url), F.lit(""))
    return F.regexp_extract(u, GREENHOUSE_URL, 1), F.regexp_extract(u, GREENHOUSE_URL, 2)


def jsonld_scripts(html) -> Column:
    """S3 first step: the bodies of every ``ld+json`` script, in page order."""
    return F.regexp_extract_all(F.coalesce(_c(html), F.lit("")), F.lit(JSONLD_SCRIPT), F.lit(1))


def application_subject(subject) -> Column:
    """The subject is about an application or interview already in hand."""
    return F.coalesce(_c(subject), F.lit("")).rlike("(?iU)(?:" + "|".join(APPLICATION_SUBJECT) + ")")


def candidate_name_subject(subject, name: str | None) -> Column:
    """The user's full name (two words or more) beside 'interview', or
    after an Re:/Fw:/Fwd: prefix. No usable name, no rule."""
    name = (name or "").strip()
    if len(name.split()) < 2:
        return F.lit(False)
    who = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in name)
    pat = (f"(?iU)\\binterview\\b.*{who}|{who}.*\\binterview\\b|^\\s*(?:re|fw|fwd)\\s*:.*{who}")
    return F.coalesce(_c(subject), F.lit("")).rlike(pat)


def alert_subject(subject, sender) -> tuple[Column, Column]:
    """(company, title) from 'X is hiring a Y' or 'Y at X: ...'; else the
    title is the subject and the company the sender's host label."""
    s = F.coalesce(_c(subject), F.lit(""))
    hiring = s.rlike(ALERT_HIRING)
    at = s.rlike(ALERT_AT)
    company = (F.when(hiring, py_strip(F.regexp_extract(s, ALERT_HIRING, 1)))
               .when(at, py_strip(F.regexp_extract(s, ALERT_AT, 2))).otherwise(F.lit("")))
    title = (F.when(hiring, py_strip(F.regexp_extract(s, ALERT_HIRING, 2)))
             .when(at, py_strip(F.regexp_extract(s, ALERT_AT, 1))).otherwise(s))
    host = F.split_part(F.element_at(F.split(F.coalesce(_c(sender), F.lit("")), "@"), -1), F.lit("."), F.lit(1))
    company = F.when(company == "", F.when(host == "", F.lit("email")).otherwise(host)).otherwise(company)
    return F.substring(company, 1, 80), F.substring(title, 1, 140)


def board_link(body, message_id) -> Column:
    """The first url in the body on a real job board, else imap://<id>."""
    urls = F.regexp_extract_all(F.coalesce(_c(body), F.lit("")), F.lit(URL_IN_TEXT), F.lit(0))
    real = F.filter(urls, lambda u: u.rlike(REAL_BOARD))
    return F.coalesce(F.get(real, 0), F.concat(F.lit("imap://"), _c(message_id).cast("string")))


def content_hash(x) -> Column:
    """The whole sha1, for keys."""
    return F.sha1(F.coalesce(_c(x), F.lit("")).cast("binary"))


def short_hash(x) -> Column:
    """First 12 hex characters of sha1."""
    return F.substring(F.sha1(F.coalesce(_c(x), F.lit("")).cast("binary")), 1, 12)


def json_candidates(text) -> tuple[Column, Column]:
    """(first try, repaired) JSON texts of a model response: fences
    removed, outermost braces kept; the repair also drops ``//`` comments
    (not after ':') and trailing commas."""
    t = py_strip(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "```(?:json)?", ""))
    start = F.instr(t, "{")
    end = F.length(t) - F.instr(F.reverse(t), "}") + 1
    has = (start > 0) & (F.instr(F.reverse(t), "}") > 0) & (end > start)
    cut = F.when(has, F.substring(t, start, end - start + 1)).otherwise(t)
    repaired = F.regexp_replace(F.regexp_replace(cut, "(?<!:)//[^\\n]*", ""), ",(\\s*[}\\]])", "$1")
    return cut, repaired


def min_text(col, n: int = 300) -> Column:
    """Long enough to be worth scoring."""
    return F.length(F.coalesce(_c(col), F.lit(""))) >= n


def unescape_html(col) -> Column:
    """Full HTML entity decoding (named and numeric), as Python's
    ``html.unescape``: a vectorised pandas UDF, the one per-row Python helper
    in this module."""
    return _unescape_udf()(_c(col))


def _unescape_udf():
    from lantern.functions._pyhelpers import unescape_udf
    return unescape_udf()


def safe_name(text) -> Column:
    """Entities decoded (all of HTML's, via a pandas UDF), reserved
    filename characters removed, whitespace collapsed, cut to 80, stripped."""
    t = unescape_html(F.coalesce(_c(text), F.lit("")))
    t = F.regexp_replace(t, '[<>:"/\\\\|?*]', "")
    t = py_strip(F.regexp_replace(t, "(?U)\\s+", " "))
    return py_strip(F.substring(t, 1, 80))


def jsonld_posting(html) -> Column:
    """S3: the first schema.org JobPosting node in the page's ``ld+json``
    scripts (a script may hold one node or a list; bad JSON is skipped), as
    struct(title, company, location, description); null when there is none."""
    def nodes(sc):
        return bound(F.try_parse_json(py_strip(sc)), lambda v: F.when(v.isNull(), F.array().cast("array<variant>"))
                     .otherwise(F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))

    def posting(node):
        def sget(path):
            return F.try_variant_get(node, path, "string")
        org_name = F.coalesce(sget("$.hiringOrganization.name"), sget("$.hiringOrganization"), F.lit(""))
        loc = F.coalesce(F.get(F.try_variant_get(node, "$.jobLocation", "array<variant>"), 0),
                         F.try_variant_get(node, "$.jobLocation", "variant"))
        location = bound(loc, lambda x: F.array_join(F.filter(F.array(
            F.try_variant_get(x, "$.address.addressLocality", "string"),
            F.try_variant_get(x, "$.address.addressRegion", "string")), lambda part: part != ""), ", "))
        tele = sget("$.jobLocationType") == "TELECOMMUTE"
        return F.when(node.isNotNull(), F.struct(
            py_strip(F.coalesce(sget("$.title"), F.lit(""))).alias("title"),
            py_strip(org_name).alias("company"),
            bound(location, lambda x: F.when(tele, F.when(x != "", F.concat(F.lit("Remote ("), x, F.lit(")")))
                                             .otherwise(F.lit("Remote"))).otherwise(x)).alias("location"),
            page_text(F.coalesce(sget("$.description"), F.lit(""))).alias("description")))

    # a script is parsed once, and the first posting's fields are read from the one node
    flat = F.flatten(F.transform(jsonld_scripts(html), nodes))
    jp = F.filter(flat, lambda n: F.try_variant_get(n, "$['@type']", "string") == "JobPosting")
    return bound(F.get(jp, 0), posting)
