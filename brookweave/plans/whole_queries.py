"""The rules of the queries over literal rows, run over the whole table columns that hold their input.

The literal queries keep their rows and SQL, which reach branches that the tables do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import text as T
from ..functions import urls as U
from ..operators import extract as E
from ..operators import markdown
from ..operators import search as S
from .web_queries import _HOST, _RAW_SQL, _STOP


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _pages(s, d, *columns: str) -> DataFrame:
    """Each record once; deliveries of one scrape_id are equal."""
    return _t(s, d, "scrape_results").filter("scrape_id is not null").select("scrape_id", *columns).dropDuplicates(["scrape_id"])


def _md(s, d):
    return _pages(s, d, "markdown").filter("markdown is not null")


def _searches(s, d):
    return _t(s, d, "search_results").filter("search_id is not null and query is not null").select("search_id", "query").dropDuplicates(["search_id"])


def _urls(s, d):
    """Every distinct address of records, links, hits and fetches."""
    url = _t(s, d, "scrape_results").select("url").union(_t(s, d, "scrape_results").select(F.explode("links.href")))
    return url.union(_t(s, d, "search_hits").select("url")).union(_t(s, d, "fetch_stats").select("url")).filter("url is not null").distinct()


def _joined(s, d):
    e = _pages(s, d, "url", "links").select("scrape_id", "url", F.posexplode("links").alias("pos", "l"))
    return e.select("scrape_id", "pos", U.absolute(F.col("l.href"), F.col("url")).alias("url"))


def _blocked(s, d):
    """Every fetch; one without a stored page is told by its status alone."""
    f = _t(s, d, "fetch_stats").filter("stat_id is not null").select("stat_id", "scrape_id", "status").dropDuplicates(["stat_id"])
    p = _pages(s, d, "clean_html").filter("clean_html is not null")
    return f.join(p, "scrape_id", "left").select("stat_id", "scrape_id", P.block_reason(F.col("status"), F.col("clean_html")).alias("reason"))


def _kinds(s, d):
    return E.documents(_pages(s, d, "url", "clean_html").filter("clean_html is not null"), "clean_html", "url", "scrape_id", False, False).select("scrape_id", F.col("page_type").alias("kind"))


QUERIES = {
    "page_type_all": _kinds,
    "block_reason_all": _blocked,
    "is_pdf_url_all": lambda s, d: _urls(s, d).select("url", U.is_pdf(F.col("url")).alias("pdf")),
    "demoted_junk_all": lambda s, d: _urls(s, d).select("url", S.demoted(F.col("url")).alias("demoted"), U.junk(F.col("url")).alias("junk")),
    "url_join_all": _joined,
    "fence_close_all": lambda s, d: _md(s, d).select("scrape_id", T.close_fence(F.col("markdown")).alias("closed")),
    "fence_state_all": lambda s, d: _md(s, d).withColumn("f", T.fence_state(F.col("markdown"))).select("scrape_id", "f.ch", "f.len"),
    "paragraphs_all": lambda s, d: _md(s, d).select("scrape_id", F.posexplode(T.paragraphs(F.col("markdown"))).alias("i", "p")),
    "query_terms_all": lambda s, d: _searches(s, d).select("search_id", F.array_join(T.query_terms(F.col("query")), "|").alias("terms")),
    "focus_query_words_all": lambda s, d: _searches(s, d).select("search_id", F.array_join(T.focus_terms(F.col("query")), "|").alias("terms")),
    "table_artifact_all": lambda s, d: _md(s, d).select("scrape_id", T.table_artifact(F.col("markdown")).alias("artifact")),
    "escaping_all": lambda s, d: _pages(s, d, "title").filter("title is not null").select("scrape_id", T.escape_html(F.col("title")).alias("html"), T.shell_quote(F.col("title")).alias("shell")),
    "readme_clean_all": lambda s, d: _md(s, d).select("scrape_id", markdown.readme("markdown").alias("readme"), markdown.clean_markdown("markdown").alias("md")),
}

_URLS_SQL = """WITH u AS (SELECT DISTINCT url FROM (SELECT url FROM scrape_results UNION ALL SELECT l.href AS url FROM (SELECT unnest(links) AS l FROM scrape_results)
 UNION ALL SELECT url FROM search_hits UNION ALL SELECT url FROM fetch_stats) WHERE url IS NOT NULL)"""
_WORDS_SQL = r"list_transform(regexp_split_to_array(query, '\s+'), lambda w: lower(regexp_replace(w, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')))"
_SEARCH_SQL = "SELECT DISTINCT search_id, query FROM search_results WHERE search_id IS NOT NULL AND query IS NOT NULL"
_MD_SQL = "SELECT DISTINCT scrape_id, markdown FROM scrape_results WHERE scrape_id IS NOT NULL AND markdown IS NOT NULL"
_COPY = "|".join(m.replace("|", r"\|") for m in P.COPY_MARKERS)

SQL = {
    "is_pdf_url_all": f"{_URLS_SQL} SELECT url, lower(regexp_replace(url, '[?#].*$', '')) LIKE '%.pdf' AS pdf FROM u",
    "demoted_junk_all": rf"""{_URLS_SQL}, h AS (SELECT url, {_HOST.format('url')} AS host FROM u) SELECT url, regexp_matches(host, 'youtube\.com|youtu\.be|pinterest\.|facebook\.com|tiktok\.com|quora\.com') AS demoted,
 contains(url, 'duckduckgo.com/y.js') OR host = '' OR regexp_matches(host, '(bing\.com|duckduckgo\.com|mojeek\.com|brave\.com|search\.yahoo\.com)$') AS junk FROM h""",
    "url_join_all": """WITH p AS (SELECT DISTINCT scrape_id, links FROM scrape_results WHERE links IS NOT NULL AND scrape_id IS NOT NULL), e AS (SELECT scrape_id, i::INT AS pos, links[i + 1].href AS href FROM p, LATERAL (SELECT unnest(range(len(links))) AS i))
 SELECT scrape_id, pos, CASE WHEN href LIKE '#%' THEN NULL ELSE href END AS url FROM e""",
    "query_terms_all": f"""WITH q AS ({_SEARCH_SQL}), t AS (SELECT search_id, list_filter({_WORDS_SQL}, lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '\\d+')) AS l FROM q)
 SELECT search_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS terms FROM t""",
    "focus_query_words_all": f"WITH q AS ({_SEARCH_SQL}) SELECT search_id, array_to_string(list_filter({_WORDS_SQL}, lambda w: strlen(w) > 2), '|') AS terms FROM q",
    "table_artifact_all": rf"""WITH m AS (SELECT scrape_id, markdown, length(markdown) - length(replace(markdown, '|', '')) AS pipes, length(regexp_replace(markdown, '[^\p{{L}}]', '', 'g')) AS letters FROM ({_MD_SQL}))
 SELECT scrape_id, pipes > 20 AND letters > 0 AND pipes::DOUBLE / greatest(letters, 1) > 0.05::DOUBLE AND contains(markdown, '|  ') AS artifact FROM m""",
    "escaping_all": """SELECT DISTINCT scrape_id, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html,
 chr(39) || replace(title, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) AS shell FROM scrape_results WHERE scrape_id IS NOT NULL AND title IS NOT NULL""",
    "block_reason_all": rf"""WITH f AS (SELECT DISTINCT stat_id, scrape_id, status FROM fetch_stats WHERE stat_id IS NOT NULL), p AS (SELECT DISTINCT scrape_id, clean_html AS h FROM scrape_results WHERE scrape_id IS NOT NULL AND clean_html IS NOT NULL),
 v AS (SELECT scrape_id, h, lower(substring(h, 1, 16384)) AS head, strlen(h) AS n, strlen(regexp_replace(regexp_replace(regexp_replace(lower(h), '{_RAW_SQL}', '<', 'g'), '(?s)<[^>]*(>|\z)', '', 'g'), '[ \t\n\r\f]', '', 'g')) AS vis,
 coalesce(list_sum(list_transform(regexp_extract_all(lower(h), '{_RAW_SQL}', 1), lambda y: strlen(y))), 0)::BIGINT + coalesce(list_sum(list_transform(regexp_extract_all(lower(h), '{_RAW_SQL}', 2), lambda y: strlen(y))), 0)::BIGINT AS scr FROM p)
 SELECT stat_id, scrape_id, CASE WHEN status IN (401, 403, 407, 429, 503) THEN 'HTTP ' || status::VARCHAR || ' from origin' WHEN n < 500 AND vis < 64 THEN 'near-empty response body'
 {' '.join(f"WHEN n < 60000 AND contains(head, '{m}') THEN '{v} challenge page'" for m, v in P.INFRA_MARKERS)} WHEN n < 60000 AND regexp_matches(head, '{_COPY}') THEN 'bot interstitial text'
 WHEN vis < 500 AND scr > 500 AND scr > 2 * vis THEN 'thin body dominated by scripts (' || vis::VARCHAR || 'B text vs ' || scr::VARCHAR || 'B script) - challenge page or client-rendered shell' END AS reason FROM f LEFT JOIN v USING (scrape_id)""",
}
