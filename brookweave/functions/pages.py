"""Page classification: what a response is worth.  Ordered CASE expressions over byte lengths and markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that mean a block, a challenge page's infrastructure with its vendor, and its texts.
BLOCK_STATUS = (401, 403, 407, 429, 503)
INFRA_MARKERS = (
    ("/cdn-cgi/challenge-platform", "Cloudflare"),
    ("captcha-delivery.com", "DataDome"),
    ("_incapsula_resource", "Imperva"),
    ("px-captcha", "PerimeterX"),
    ("/_sec/cp_challenge", "Akamai"),
    ("geo.captcha", "DataDome"),
)
COPY_MARKERS = (
    "just a moment",
    "cf-browser-verification",
    "checking your browser",
    "cf_chl_opt",
    "enable javascript and cookies to continue",
    "attention required! | cloudflare",
    "__cf_chl",
    "please enable js",
    "please enable javascript",
    "verifying you are human",
)
#: Markers of a result page that is a block, in their order.
SERP_MARKERS = (
    ("anomaly", ("anomaly.js", "/anomaly")),
    ("cloudflare", ("/cdn-cgi/challenge", "challenge-platform", "cf-chl")),
    ("captcha", ("g-recaptcha", "recaptcha/api", "hcaptcha", "unusual traffic", "are you a robot", "verify you are a human")),
)
#: Scripts and styles up to their end tag, or to the end of the page.
RAW = r"(?s)(<script.*?)(?:</script|\z)|(<style.*?)(?:</style|\z)"


def visible_bytes(html: Column) -> Column:
    """Bytes outside tags, scripts and styles that are no white space."""
    bare = F.regexp_replace(F.lower(html), RAW, "<")
    return F.octet_length(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*(>|\z)", ""), r"[ \t\n\r\f]", "")).cast("bigint")


def script_bytes(html: Column) -> Column:
    """Bytes of scripts and styles before their end tags."""
    low = F.lower(html)
    total = lambda g: F.aggregate(F.regexp_extract_all(low, F.lit(RAW), F.lit(g)), F.lit(0).cast("bigint"), lambda a, x: a + F.octet_length(x))
    return total(1) + total(2)


def _any(text: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def block_reason(status: Column, html: Column) -> Column:
    """Why a response is a bot wall: status, near-empty body, challenge page, script shell; null if it is none."""
    head = F.lower(F.substring(html, 1, 16_384))
    vis, scr, size = visible_bytes(html), script_bytes(html), F.octet_length(html)
    out = F.when(status.isin(*BLOCK_STATUS), F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" from origin")))
    out = out.when((size < 500) & (vis < 64), F.lit("near-empty response body"))
    for m, vendor in INFRA_MARKERS:
        out = out.when((size < 60_000) & F.contains(head, F.lit(m)), F.lit(f"{vendor} challenge page"))
    out = out.when((size < 60_000) & _any(head, COPY_MARKERS), F.lit("bot interstitial text"))
    shell = F.concat(
        F.lit("thin body dominated by scripts ("), vis.cast("string"), F.lit("B text vs "), scr.cast("string"), F.lit("B script) - challenge page or client-rendered shell")
    )
    return out.when((vis < 500) & (scr > 500) & (scr > 2 * vis), shell)


def serp_marker(html: Column) -> Column:
    """anomaly, cloudflare or captcha where a result page is a block; null if it is none."""
    low = F.lower(html)
    return F.coalesce(*(F.when(_any(low, needles), F.lit(name)) for name, needles in SERP_MARKERS))


def serp_status(engine: Column, status: Column, html: Column, hits: Column) -> Column:
    """timeout, blocked:why, error:status, empty or ok:n of an engine's response."""
    text = (
        F.when(status.isNull(), F.lit("timeout"))
        .when(status.isin(202, 403, 429), F.concat(F.lit("blocked:http"), status.cast("string")))
        .when(status != 200, F.concat(F.lit("error:http"), status.cast("string")))
        .when(serp_marker(html).isNotNull(), F.concat(F.lit("blocked:"), serp_marker(html)))
        .when(hits == 0, F.lit("empty"))
        .otherwise(F.concat(F.lit("ok:"), hits.cast("string")))
    )
    return F.concat(engine, F.lit(":"), text)


def thin(md_len: Column, text_len: Column, html_len: Column) -> Column:
    return ((md_len < 200) & (html_len > 2000)) | ((text_len < 100) & (html_len > 1500)) | (md_len == 0)


def content_ok(md_len: Column, text_len: Column, html_len: Column, blocked: Column, escalated: Column, first_reason: Column, page_type: Column, links: Column) -> Column:
    """Whether a page holds content: not blocked, and if thin only as a list; a list of over ten links always counts."""
    t = thin(md_len, text_len, html_len)
    wall = escalated & t & first_reason.isNotNull()
    base = F.when(blocked | wall, F.lit(False)).when(t, (page_type == "list") & (md_len > 100)).otherwise(F.lit(True))
    return base | ((page_type == "list") & (links > 10) & (md_len > 50))


def content_notes(ok: Column, blocked: Column, wall: Column, tier: Column, why: Column, html_len: Column, page_type: Column) -> Column:
    """struct(note, next_action) of a page that holds no content; nulls where it does."""
    bot = F.concat(F.lit("bot protection not bypassed (tier "), tier, F.lit(", "), F.coalesce(why, F.lit("blocked")), F.lit("); no article recovered"))
    none = F.concat(
        F.lit("no article extracted from "), html_len.cast("string"), F.lit(" bytes of HTML (app shell, index, or media page) - type: "), page_type
    )
    other = "site likely uses DataDome/Turnstile/Akamai, which no free tool bypasses - try another path on this domain or a different source"
    walled = blocked | wall
    return F.struct(
        F.when(~ok, F.when(walled, bot).otherwise(none)).alias("note"),
        F.when(~ok, F.when(walled, F.lit(other)).otherwise(F.lit("page has no prose to extract - try a specific article URL"))).alias("next_action"),
    )


def page_type(links: Column, link_text: Column, text: Column, p_text: Column, markdown: Column) -> Column:
    return (
        F.when((links >= 10) & (5 * link_text >= 2 * text) & (p_text < 200), F.lit("list"))
        .when(F.contains(markdown, F.lit("![")) & (text < 500), F.lit("media"))
        .when(text >= 100, F.lit("article"))
        .otherwise(F.lit("unknown"))
    )


def quality_score(text: Column, html: Column, title: Column, links: Column) -> Column:
    """0 to 1 from the share of text, its length, a title and a moderate number of links; lengths in bytes."""
    one = F.lit(1.0)
    score = (
        0.4 * F.least(5.0 * text / F.greatest(html, F.lit(1)), one)
        + 0.3 * F.least(text / 5000.0, one)
        + F.when(title > 5, F.lit(0.15)).otherwise(F.lit(0.0))
        + F.when((links > 0) & (links < 50), F.lit(0.15)).otherwise(F.lit(0.0))
    )
    return F.when(text <= 0, F.lit(0.0)).otherwise(F.least(score, one))
