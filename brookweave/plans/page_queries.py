"""Extraction, result-page, README, facts and composite pipeline queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api as API
from ..functions import text as T
from ..functions import urls as U
from ..operators import extract as E
from ..operators import bench as BN
from ..operators import facts, markdown, serp
from ..operators import focus as X
from ..operators import render as R
from ..operators import search as S
from ..operators import state as ST
from ..sources import readers
from .web_queries import _RANK_SQL


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _rows(s, rows, schema):
    return s.createDataFrame(rows, schema)


def _pages(s, d):
    return _t(s, d, "scrape_results").filter("clean_html is not null and scrape_id is not null").select("scrape_id", "url", "clean_html").distinct()


def _extract(s, d):
    """The documents that the pages' html gives; distinct rows are taken before the parse."""
    return E.documents(_pages(s, d), "clean_html", "url", "scrape_id")


PAGE = """<html><head><title> A  page </title><meta name="description" content="about it"></head><body><nav><a href="/n">Menu</a></nav>
<article><h1>Head</h1><p>First <b>bold</b> paragraph with <a href="x?y=1">a link</a> and enough words to count as content of a page that is long enough.<p>Second one &amp; more, also with a fair number of words so that the article has two hundred bytes in all.
<pre><code class="language-py">x = "```"</code></pre><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><img src="/i.png" alt="pic"></article><footer>end</footer></body></html>"""


def _sample(s, d):
    docs = E.documents(_rows(s, [(1, "https://a.example/d/", PAGE), (2, "https://a.example/", None)], "id int, url string, html string"), "html", "url", "id")
    return docs.select("id", "title", "description", "markdown", "page_type", F.size("links").alias("n_links"), F.array_join("media", " ").alias("media"))


_SAMPLE_MD = (
    "# Head\n\nFirst **bold** paragraph with [a link](https://a.example/d/x?y=1) and enough words to count as content of a page that is long enough.\n\n"
    "Second one & more, also with a fair number of words so that the article has two hundred bytes in all.\n\n````py\nx = \"```\"\n````\n\n- one\n- two\n\na | b\n\n![pic](https://a.example/i.png)"
)


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SERP = {
    "ddg": '<div class="result results_links"><h2 class="result__title"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx">One</a></h2><a class="result__snippet" href="https://a.example/x">text <b>one</b></a></div><div class="result"><h2 class="result__title"><a href="https://duckduckgo.com/y.js?ad">Ad</a></h2><a class="result__snippet">ad text</a></div><div class="result"><h2 class="result__title"><a href="https://b.example/">Two</a></h2></div>',
    "bing": '<ol><li class="b_algo"><h2><a href="https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9iLmV4YW1wbGUvcA&x=1">Bee</a></h2><div class="b_caption"><p>about bees</p></div></li></ol>',
    "brave": '<div class="snippet" data-type="web"><a href="https://f.example/w"><div class="site">f.example <span>w</span></div><div class="title search-snippet-title">Eff</div></a><div class="generic-snippet">eff text</div></div><div data-type="news"><a href="https://n.example/">News</a></div>',
    "mojeek": '<ul class="results-standard"><li><a class="title" href="https://g.example/">Gee</a><p class="s">gee text</p></li></ul>',
    "ddg-lite": '<table><tr><td><a class="result-link" href="https://c.example/">See</a></td></tr><tr><td class="result-snippet">sea text</td></tr><tr><td><a class="result-link" href="https://d.example/">Dee</a></td></tr></table>',
    "yahoo": '<div class="dd algo"><div class="compTitle"><a href="https://r.search.yahoo.com/RU=https%3a%2f%2fe.example%2fq/RK=2"><span>e.example</span><h3 class="title">Ee</h3></a></div><div class="compText"><p>e text</p></div></div>',
}


def _serp(s, d):
    rows = _rows(s, list(SERP.items()), "engine string, html string")
    hits = rows.select("engine", F.posexplode(serp.parse_serp("engine", "html")).alias("rank", "h"))
    return hits.select("engine", "rank", "h.title", "h.url", "h.snippet")


README = "<!-- hidden\nstill -->\n<p align=center>\n[![build](b.svg)](u)\n# Tool\n\n\n[ref]: http://x\nUse **it** <br> well.\n```html\n<!-- kept -->\n<p>\n```\n</p>"
MESSY = "---\nTitle\n\n\n\n\ntext   wide\n```\na   b\n\n\n\nc\n```\n    code   stays\nend"


def _readme(s, d):
    r = _rows(s, [(1, README, MESSY), (2, None, None), (3, "", "")], "id int, readme string, md string")
    return r.select("id", markdown.readme("readme").alias("readme"), markdown.clean_markdown("md").alias("md"))


REPO = json.dumps({"full_name": "o/r", "description": "", "stargazers_count": 5, "forks_count": 1, "license": {"spdx_id": "MIT"}, "topics": ["a", "b"], "pushed_at": "2024-05-06T01:02:03Z", "default_branch": "main", "html_url": "https://h.example/o/r"})
RELEASE = json.dumps({"tag_name": "v1", "published_at": "2024-01-02T00:00:00Z"})
CRATE = json.dumps({"crate": {"name": "c", "max_stable_version": "1.0.0", "description": "d", "downloads": 9, "recent_downloads": 2, "updated_at": "2023-01-01T00:00:00Z"}})
NPM = json.dumps({"name": "n", "version": "2.0.0", "license": {"type": "ISC"}, "repository": {"url": "git+https://h.example/n.git"}})
FOUND = json.dumps({"objects": [{"package": {"name": "n", "version": "2.0.0", "date": "2022-02-02T00:00:00Z"}}]})
OTHER = json.dumps({"objects": [{"package": {"name": "n", "version": "1.9.0", "date": "2021-02-02T00:00:00Z"}}]})
PYPI = json.dumps({"info": {"name": "p", "version": "3", "summary": "s", "requires_python": ">=3.9", "project_urls": {"Homepage": "h", "Docs": "d", "Source code": "c"}}, "releases": {"3": [{"upload_time": "2020-03-04T05:06:07"}]}})


def _facts(s, d):
    r = _rows(s, [(REPO, RELEASE, CRATE, NPM, PYPI, FOUND, OTHER)], "repo string, release string, crate string, npm string, pypi string, found string, other string")
    npm = lambda found: facts.npm(F.col("npm"), facts.npm_date(F.col("npm"), F.col(found)))
    kinds = F.array(
        F.struct(F.lit("repo").alias("kind"), facts.repository(F.col("repo"), F.col("release")).alias("text")), F.struct(F.lit("crate").alias("kind"), facts.crate(F.col("crate")).alias("text")),
        F.struct(F.lit("npm").alias("kind"), npm("found").alias("text")), F.struct(F.lit("npm, other version").alias("kind"), npm("other").alias("text")),
        F.struct(F.lit("pypi").alias("kind"), facts.pypi(F.col("pypi")).alias("text")),
    )
    return r.select(F.explode(kinds).alias("k")).select("k.kind", "k.text")


REPOS = [
    ("o/a", 200, REPO, 200, RELEASE, 200, "[]", 200, "# A\n\nFirst part.\n\nAbout valves."),
    ("o/b", 200, REPO, 404, "", 200, '[{"name": "t2"}]', 404, ""),
    ("o/c", 200, REPO, 404, "", 200, "[]", 200, "plain"),
    ("o/d", 200, REPO, 500, "", 500, "", 403, "API rate limit exceeded"),
    ("o/e", 404, "", 0, "", 0, "", 0, ""),
    ("o/f", 200, "no json", 0, "", 0, "", 0, ""),
]


def _repo_summary(s, d):
    """Repository, latest release or newest tag and README excerpt of each spec; a failed repository is an error row."""
    r = _rows(s, REPOS, "spec string, repo_status int, repo string, rel_status int, rel string, tag_status int, tags string, readme_status int, readme string")
    return facts.summaries(r, ["valves"], 200).select("spec", "text", "error")


_NL = "' || chr(10) || '"


def _errors(s, d):
    rows = [(1, "GitHub", 404, False, ""), (2, "GitHub", 429, False, ""), (3, "GitHub", 403, True, ""), (4, "GitHub", 403, False, "API Rate Limit exceeded"), (5, "GitHub", 403, False, ""), (6, "GitHub", 500, False, ""), (7, "npm", 403, False, "rate limit"), (8, "npm", 429, False, "")]
    r = _rows(s, rows, "id int, svc string, status int, gone boolean, body string")
    return r.select("id", facts.http_error(F.col("svc"), F.col("status"), F.col("gone"), F.col("body")).alias("error"))


def _answers(s, d):
    rows = [(1, 200, '{"a": 1}'), (2, 200, "oops"), (3, 404, "{}"), (4, 200, "")]
    r = _rows(s, rows, "id int, status int, body string")
    a = facts.answer(F.lit("PyPI"), F.col("status"), F.lit(False), F.col("body"), F.lit("https://r.example/j"))
    return r.select("id", a.alias("a")).select("id", "a.body", "a.error")


def _fetch_errors(s, d):
    """Every fetch of the log with its service's error text."""
    f = _t(s, d, "fetch_stats").filter("stat_id is not null and status is not null").select("stat_id", "op", "status").dropDuplicates(["stat_id"])
    bad = ~F.col("status").between(200, 299)
    return f.select("stat_id", F.when(bad, facts.http_error(F.coalesce("op", F.lit("fetch")), F.col("status"), F.lit(False), F.lit(""))).alias("error"))


def _joined_facts(s, d):
    """Hits and pages meet on address and title, as a manifest and a search answer on name and version."""
    h = _t(s, d, "search_hits").filter("hit_id is not null and url is not null").select("hit_id", "url", "title").dropDuplicates(["hit_id"])
    p = _t(s, d, "scrape_results").filter("url is not null and title is not null").groupBy("url", "title").agg(F.max("fetched_at").alias("at"))
    return h.join(p, ["url", "title"], "left").select("hit_id", F.substring(F.col("at").cast("string"), 1, 10).alias("day"))


def _unique_pages(s, d, *columns: str) -> DataFrame:
    """Each record once: the ids are compared, never the texts."""
    return _t(s, d, "scrape_results").filter("scrape_id is not null").select("scrape_id", *columns).dropDuplicates(["scrape_id"])


def _pipeline(s, d):
    """The page pipeline over stored pages: validate, judge, focus, cut, headings."""
    p = _unique_pages(s, d, "url", "markdown", "clean_html", "links", "blocked", "page_type", "tier").filter(U.valid(F.col("url")))
    p = API.paged(API.judged(p), ["garden", "bridge"], 0, 2500)
    return p.select(
        "scrape_id", "ok", "note", "next_action", "missed", "next_offset", F.length("page").alias("chars"), F.size(T.headings(F.col("page"))).alias("n_headings"),
        F.length("md").alias("total_chars"), F.length("focused").alias("focused_chars"),
    )


def _from_html(s, d):
    """The page pipeline from the response: validate, extract, judge, focus, cut, links, media, headings."""
    p = _unique_pages(s, d, "url", "clean_html", "blocked", "tier").filter(U.valid(F.col("url"))).withColumnRenamed("clean_html", "response")
    got = E.documents(p, "response", "url", "scrape_id", keep=["url", "blocked", "tier", "response"]).withColumnRenamed("clean_html", "sanitized").withColumnRenamed("response", "clean_html")
    q = API.paged(API.judged(got), ["garden", "bridge"], 0, 2500)
    return q.select(
        "scrape_id", "title", "ok", "note", "missed", "next_offset", F.length("page").alias("chars"), F.length("md").alias("total_chars"), "page_type", F.round("quality_score", 6).alias("quality"),
        F.size("links").alias("n_links"), F.size("media").alias("n_media"), F.size(T.headings(F.col("page"))).alias("n_headings"), F.length("sanitized").alias("clean_chars"),
    )


def _scraped(s, d):
    """The scrape verb over all responses; refused addresses are error rows."""
    p = _unique_pages(s, d, "url", "clean_html", "blocked", "tier").withColumnRenamed("clean_html", "response")
    r = API.scrape(p, API.ScrapeOptions(focus="garden bridge", links=True, media=True), "scrape_id")
    return r.select("scrape_id", "content_ok", "note", "page_type", "total_chars", "next_offset", F.size("headings").alias("n_headings"))


def _linked(s, d):
    return API.links(_t(s, d, "scrape_results"), API.LinkOptions(filter="an"))


def _engine_state(s, d):
    """State of the engines after all hits; a search whose rank is 9 or more counts as blocked here."""
    h = _t(s, d, "search_hits").filter("engine is not null and served_at is not null")
    ms = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', served_at) div 1000")
    old = s.createDataFrame([("ddg", 1, 9), ("none", 5, 7)], "engine string, last_ms bigint, cooldown_until_ms bigint")
    return API.engine_state(old, h.select("engine", ms.alias("ms"), (F.col("rank") >= 9).alias("blocked")))


def _pdf(s, d):
    """PDF bodies as results: their text, or a note where none could be read."""
    rows = [(1, "https://a.example/x.pdf", "A title of a paper.\n\nIts text goes on here.", 900, "1-2"), (2, "https://a.example/y.pdf", "  too short ", 400, None), (3, "https://a.example/z.pdf", None, 10, None)]
    r = _rows(s, rows, "id int, url string, text string, size int, pages string")
    return r.select("id", readers.pdf_result("url", "text", "size", "pages").alias("p")).select("id", "p.*")


def _cache_lookup(s, d):
    """Every record asks, when it is ingested, the cache of what was logged last for its address."""
    cache = _t(s, d, "fetch_stats").filter("url is not null").groupBy("url").agg(F.max("logged_at").alias("fetched"))
    r = _unique_pages(s, d, "url", "ingested_at")
    return ST.lookup(r, cache, "url", F.col("ingested_at"), "fetched").select("scrape_id", F.col("_at").isNotNull().alias("hit"))


def _cache_store(s, d):
    """The fetch log written into a cache of 50 entries by key with options; only usable pages are kept."""
    f = _t(s, d, "fetch_stats").filter("url is not null and stat_id is not null").select("stat_id", "url", "chars_out", "truncated", "status", "logged_at").dropDuplicates(["stat_id"])
    key = ST.cache_key_options(F.col("url"), F.lit(None).cast("string"), F.lit(25_000), F.lit(None).cast("int"), F.coalesce("truncated", F.lit(False)), F.lit("1-2"), F.lit(None).cast("array<string>"))
    new = f.filter("status = 200").select(key.alias("key"), F.struct("logged_at", "stat_id").alias("at"), "chars_out")
    return ST.store(new.limit(0), new, "key", "at", 50).select("key", "at.stat_id", "chars_out")


def _cache(s, d):
    """A later request of a url is answered by the record fetched within the hour before it."""
    p = _t(s, d, "fetch_stats").filter("url is not null").select("stat_id", "url", "logged_at").distinct()
    return ST.cache_hits(p, "url", "logged_at", "stat_id").select("stat_id", "hit")


def _url_file(s, d):
    v = _rows(s, [(" https://a.example/ ",), ("# note",), ("",), ("https://b.example/x",)], "value string")
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return v.select(line.alias("url")).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def _bodies(s, d):
    r = _rows(s, [(1, bytearray("zażółć".encode("cp1250")), "text/html; charset=windows-1250"), (2, bytearray("ü".encode()), None), (3, bytearray(b"%PDF-1.7"), "x")], "id int, body binary, kind string")
    return r.select("id", readers.decode_body("body", "kind").alias("text")).withColumn("pdf", readers.is_pdf_body(F.col("text")))


def _class_noise(s, d):
    r = _rows(s, [(1, "main-nav top"), (2, "navigate"), (3, "post_share"), (4, "content"), (5, "Sign_Up"), (6, "comments"), (7, "x mw-jump-link")], "id int, cls string")
    names = F.transform(F.split("cls", r"\s+"), lambda x: F.concat(F.lit("-"), F.replace(F.lower(x), F.lit("_"), F.lit("-")), F.lit("-")))
    return r.select("id", F.exists(names, lambda x: x.rlike("-(" + "|".join(E.NOISE) + ")-")).alias("noise"))


def _lookup_sink(s, d):
    """Every fetch of the log as a lookup: its page's title, or its error with the address that failed."""
    f = _t(s, d, "fetch_stats").filter("stat_id is not null and url is not null").select("stat_id", "url", "status", "scrape_id").dropDuplicates(["stat_id"])
    p = _unique_pages(s, d, "title").filter("title is not null")
    error = F.when(F.col("status") != 200, F.concat(F.lit("HTTP "), F.col("status").cast("string")))
    f = f.join(p, "scrape_id", "left").withColumn("error", error)
    return f.select("stat_id", R.lookup_line(F.col("url"), F.when(F.col("error").isNull(), F.col("title")), F.col("error")).alias("line"))


def _search_list(s, d):
    """The lines of the fused hits of each search, best first."""
    from .web_queries import _ranked

    best = S.top(_ranked(s, d), "search_id", 10)
    return best.select("search_id", "pos", R.hit_line(F.col("pos"), F.col("title"), F.col("url"), F.col("snippet")).alias("line"))


def _search_head(s, d):
    r = _t(s, d, "search_results").filter("search_id is not null and query is not null")
    return r.select("search_id", R.search_head(F.col("query"), F.col("warning")).alias("head")).distinct()


def _answer_scores(s, d):
    """Indicators of each page as an answer: three links, three that lead to no engine, a year, a number near its size."""
    p = _unique_pages(s, d, "markdown").filter("markdown is not null")
    return p.select("scrape_id", BN.indicators(F.col("markdown"), F.length("markdown")).alias("x")).select("scrape_id", "x.*")


def _engines_union(s, d):
    h = _t(s, d, "search_hits").filter("url is not null").select("engine", "url")
    parts = [h.filter(F.col("engine") == e).select("url").distinct().withColumn("ord", F.lit(i)) for i, e in enumerate(("ddg", "bing", "brave", "mojeek", "yahoo"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unseen(s, d):
    h = _t(s, d, "search_hits").filter("url is not null").select(U.normalize(F.col("url")).alias("url")).distinct()
    p = _t(s, d, "scrape_results").filter("url is not null").select(U.normalize(F.col("url")).alias("url"))
    return h.join(p, "url", "left_anti")


_N = r"""(SELECT DISTINCT CASE WHEN p LIKE '%/' AND length(p) > 8 THEN substring(p, 1, length(p) - 1) ELSE p END AS url FROM
 (SELECT CASE WHEN regexp_matches(b, '^[a-z]+://[^/?]+$') THEN b || '/' ELSE b END AS p FROM (SELECT lower(hd) || substring(bare, length(hd) + 1) AS b FROM
 (SELECT regexp_replace(url, '#.*$', '') AS bare, regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS hd FROM {0} WHERE url IS NOT NULL))))"""

QUERIES = {
    "extract_markdown": _extract,
    "extract_sample": _sample,
    "serp_parse": _serp,
    "readme_clean": _readme,
    "facts": _facts,
    "facts_joins": _joined_facts,
    "http_err_map": _errors,
    "scrape_pipeline": _pipeline,
    "scrape_from_html": _from_html,
    "scrape_verb": _scraped,
    "links_verb": _linked,
    "engine_state": _engine_state,
    "pdf_result": _pdf,
    "repo_summary": _repo_summary,
    "json_answers": _answers,
    "fetch_errors": _fetch_errors,
    "cache_lookup": _cache_lookup,
    "cache_store": _cache_store,
    "search_head": _search_head,
    "fetch_cache_hits": _cache,
    "url_file": _url_file,
    "charset_decode": _bodies,
    "class_noise": _class_noise,
    "lookup_sink": _lookup_sink,
    "search_list": _search_list,
    "bench_quality": _answer_scores,
    "engines_union": _engines_union,
    "unseen_urls": _unseen,
    "json_sink": lambda s, d: _t(s, d, "search_results").filter("search_id is not null").select("search_id", F.to_json(F.struct(F.col("query"), F.col("total"))).alias("json")).distinct(),
}

SQL = {
    "extract_sample": f"SELECT * FROM (VALUES (1, 'A page', 'about it', {_sql(_SAMPLE_MD)}, 'media', 2, 'https://a.example/i.png'), (2, '', '', '', 'unknown', 0, '')) t(id, title, description, markdown, page_type, n_links, media)",
    "serp_parse": """SELECT * FROM (VALUES ('ddg', 0, 'One', 'https://a.example/x', 'text one'), ('ddg', 1, 'Two', 'https://b.example/', ''), ('bing', 0, 'Bee', 'https://b.example/p', 'about bees'),
 ('brave', 0, 'Eff', 'https://f.example/w', 'eff text'), ('mojeek', 0, 'Gee', 'https://g.example/', 'gee text'),
 ('ddg-lite', 0, 'See', 'https://c.example/', 'sea text'), ('ddg-lite', 1, 'Dee', 'https://d.example/', ''), ('yahoo', 0, 'Ee', 'https://e.example/q', 'e text')) t(engine, rank, title, url, snippet)""",
    "facts": f"""SELECT * FROM (VALUES ('repo', '# o/r{_NL}Stars: 5 · Forks: 1 · Open issues: ?{_NL}License: MIT · Default branch: main · Last push: 2024-05-06{_NL}Latest release: v1 (2024-01-02){_NL}Topics: a, b{_NL}URL: https://h.example/o/r'),
 ('crate', '# c 1.0.0{_NL}d{_NL}Updated: 2023-01-01 · Downloads: 9 total, 2 last 90 days{_NL}Registry: https://crates.io/crates/c{_NL}Docs: https://docs.rs/c'),
 ('npm', '# n 2.0.0{_NL}Published: 2022-02-02 · License: ISC{_NL}Registry: https://www.npmjs.com/package/n{_NL}Repository: https://h.example/n'),
 ('npm, other version', '# n 2.0.0{_NL}Published: ? · License: ISC{_NL}Registry: https://www.npmjs.com/package/n{_NL}Repository: https://h.example/n'),
 ('pypi', '# p 3{_NL}s{_NL}Released: 2020-03-04 · Requires Python: >=3.9{_NL}Registry: https://pypi.org/project/p/{_NL}Homepage: h{_NL}Source code: c')) t(kind, text)""",
    "repo_summary": f"""WITH h AS (SELECT '# o/r{_NL}Stars: 5 · Forks: 1 · Open issues: ?{_NL}License: MIT · Default branch: main · Last push: 2024-05-06{_NL}' AS a, 'Topics: a, b{_NL}URL: https://h.example/o/r' AS b)
 SELECT spec, text, error FROM (SELECT 'o/a' AS spec, a || 'Latest release: v1 (2024-01-02){_NL}' || b || '{_NL}{_NL}## README (excerpt){_NL}About valves.' AS text, NULL::VARCHAR AS error FROM h
 UNION ALL SELECT 'o/b', a || 'Latest tag: t2{_NL}' || b || '{_NL}{_NL}<!-- readme unavailable: not found on GitHub -->', NULL FROM h
 UNION ALL SELECT 'o/c', a || 'Latest release: none{_NL}' || b || '{_NL}{_NL}## README (excerpt){_NL}plain{_NL}{_NL}<!-- focus matched nothing; unfocused page shown -->', NULL FROM h
 UNION ALL SELECT 'o/d', a || b || '{_NL}{_NL}<!-- readme unavailable: rate limited; set GITHUB_TOKEN -->', NULL FROM h
 UNION ALL SELECT 'o/e', NULL, 'not found on GitHub' UNION ALL SELECT 'o/f', NULL, 'invalid JSON from https://api.github.com/repos/o/f')""",
    "facts_joins": "WITH h AS (SELECT DISTINCT hit_id, url, title FROM search_hits WHERE hit_id IS NOT NULL AND url IS NOT NULL), p AS (SELECT url, title, max(fetched_at) AS seen FROM scrape_results WHERE url IS NOT NULL AND title IS NOT NULL GROUP BY url, title) SELECT hit_id, strftime(seen, '%Y-%m-%d') AS day FROM h LEFT JOIN p USING (url, title)",
    "http_err_map": "SELECT * FROM (VALUES (1, 'not found on GitHub'), (2, 'rate limited (secondary limit); set GITHUB_TOKEN'), (3, 'rate limited; set GITHUB_TOKEN'), (4, 'rate limited; set GITHUB_TOKEN'), (5, 'access denied (403)'), (6, 'GitHub returned HTTP 500'), (7, 'npm returned HTTP 403'), (8, 'npm returned HTTP 429')) t(id, error)",
    "json_answers": "SELECT * FROM (VALUES (1, '{\"a\": 1}', NULL), (2, NULL, 'invalid JSON from https://r.example/j'), (3, NULL, 'not found on PyPI'), (4, NULL, 'invalid JSON from https://r.example/j')) t(id, body, error)",
    "fetch_errors": "SELECT DISTINCT stat_id, CASE WHEN status BETWEEN 200 AND 299 THEN NULL WHEN status = 404 THEN 'not found on ' || coalesce(op, 'fetch') ELSE coalesce(op, 'fetch') || ' returned HTTP ' || status::VARCHAR END AS error FROM fetch_stats WHERE stat_id IS NOT NULL AND status IS NOT NULL",
    "links_verb": r"""WITH p AS (SELECT DISTINCT scrape_id, links FROM scrape_results WHERE links IS NOT NULL AND scrape_id IS NOT NULL),
 e AS (SELECT scrape_id, i::INT AS pos, regexp_replace(links[i + 1].href, '#.*$', '') AS href, links[i + 1].text AS text FROM p, LATERAL (SELECT unnest(range(len(links))) AS i)),
 f AS (SELECT scrape_id, href, min(pos) AS pos, arg_min(coalesce(text, chr(0)), pos) AS t FROM e WHERE regexp_matches(href, '^https?://') GROUP BY scrape_id, href),
 g AS (SELECT *, row_number() OVER (PARTITION BY scrape_id ORDER BY pos) AS r FROM (SELECT scrape_id, pos, href, CASE WHEN t = chr(0) THEN NULL ELSE t END AS text FROM f) WHERE contains(lower(href), 'an') OR contains(lower(coalesce(text, '')), 'an'))
 SELECT scrape_id, pos, href, coalesce(nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), ''), '(no text)') AS text FROM g WHERE r <= 100""",
    "engine_state": """WITH h AS (SELECT engine, date_diff('microsecond', TIMESTAMP '1970-01-01', served_at) // 1000 AS ms, rank >= 9 AS b FROM search_hits WHERE engine IS NOT NULL AND served_at IS NOT NULL
 ), u AS (SELECT engine, ms, CASE WHEN b THEN ms + CASE WHEN engine LIKE 'ddg%' THEN 600000 ELSE 120000 END END AS c FROM h UNION ALL SELECT 'ddg', 1, 9 UNION ALL SELECT 'none', 5, 7)
 SELECT engine, max(ms)::BIGINT AS last_ms, coalesce(max(c), 0)::BIGINT AS cooldown_until_ms FROM u GROUP BY engine""",
    "pdf_result": f"""SELECT * FROM (VALUES (1, true, 'A title of a paper.{_NL}{_NL}Its text goes on here.', 'pages=1-2 not applied; whole PDF text returned', NULL, 43, 0.6::DOUBLE), (2, false, 'too short', 'no text extracted from PDF (400 bytes): pdftotext missing, or scanned/image-only PDF', 'install poppler-utils (pdftotext) or use an HTML version of this document', 9, 0.2::DOUBLE),
 (3, false, '', 'no text extracted from PDF (10 bytes): pdftotext missing, or scanned/image-only PDF', 'install poppler-utils (pdftotext) or use an HTML version of this document', 0, 0.2::DOUBLE)) t(id, content_ok, markdown, note, next_action, total_chars, quality_score)""",
    "cache_lookup": """WITH c AS (SELECT url, max(logged_at) AS seen FROM fetch_stats WHERE url IS NOT NULL GROUP BY url), r AS (SELECT DISTINCT scrape_id, url, ingested_at FROM scrape_results WHERE scrape_id IS NOT NULL)
 SELECT scrape_id, coalesce(date_diff('microsecond', seen, ingested_at) BETWEEN 0 AND 3599999999, false) AS hit FROM r LEFT JOIN c USING (url)""",
    "cache_store": """WITH f AS (SELECT DISTINCT stat_id, url || '||25000|0|' || coalesce(truncated, false)::VARCHAR || '|1-2|0' AS key, chars_out, logged_at FROM fetch_stats WHERE url IS NOT NULL AND stat_id IS NOT NULL AND status = 200),
 l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY logged_at DESC, stat_id DESC) AS r FROM f) WHERE r = 1) SELECT key, stat_id, chars_out FROM l ORDER BY logged_at DESC, stat_id DESC, key LIMIT 50""",
    "search_head": "SELECT DISTINCT search_id, '# ' || query || CASE WHEN warning IS NULL THEN '' ELSE chr(10) || '<!-- warning: ' || warning || ' -->' END AS head FROM search_results WHERE search_id IS NOT NULL AND query IS NOT NULL",
    "json_sink": "SELECT DISTINCT search_id, (CASE WHEN query IS NULL THEN json_object('total', total) ELSE json_object('query', query, 'total', total) END)::VARCHAR AS json FROM search_results WHERE search_id IS NOT NULL",
    "fetch_cache_hits": "WITH p AS (SELECT DISTINCT stat_id, url, logged_at FROM fetch_stats WHERE url IS NOT NULL) SELECT stat_id, coalesce(date_diff('microsecond', lag(logged_at) OVER (PARTITION BY url ORDER BY logged_at, stat_id), logged_at) < 3600000000, false) AS hit FROM p",
    "url_file": "SELECT * FROM (VALUES ('https://a.example/'), ('https://b.example/x')) t(url)",
    "charset_decode": "SELECT * FROM (VALUES (1, 'zażółć', false), (2, 'ü', false), (3, '%PDF-1.7', true)) t(id, text, pdf)",
    "class_noise": "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, true), (6, false), (7, true)) t(id, noise)",
    "lookup_sink": """WITH f AS (SELECT DISTINCT stat_id, url, status, scrape_id FROM fetch_stats WHERE stat_id IS NOT NULL AND url IS NOT NULL), p AS (SELECT DISTINCT scrape_id, title FROM scrape_results WHERE scrape_id IS NOT NULL AND title IS NOT NULL)
 SELECT stat_id, coalesce(CASE WHEN status = 200 OR status IS NULL THEN title END, 'error: ' || url || ': ' || CASE WHEN status <> 200 THEN 'HTTP ' || status::VARCHAR ELSE 'no answer' END) AS line FROM f LEFT JOIN p USING (scrape_id)""",
    "search_list": f"WITH {_RANK_SQL} SELECT search_id, pos::INT AS pos, pos::VARCHAR || '. ' || title || ' — ' || url || CASE WHEN snippet <> '' THEN chr(10) || '   ' || snippet ELSE '' END AS line FROM best WHERE pos <= 10",
    "bench_quality": BN.SQL,
    "engines_union": "SELECT DISTINCT url, CASE engine WHEN 'ddg' THEN 0 WHEN 'bing' THEN 1 WHEN 'brave' THEN 2 WHEN 'mojeek' THEN 3 ELSE 4 END::INT AS ord FROM search_hits WHERE url IS NOT NULL AND engine IN ('ddg', 'bing', 'brave', 'mojeek', 'yahoo')",
    "unseen_urls": f"SELECT url FROM {_N.format('search_hits')} WHERE url NOT IN (SELECT url FROM {_N.format('scrape_results')})",
}
