"""URL, classification, search, crawl and state queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pages as P
from ..functions import urls as U
from ..operators import crawl as C
from ..operators import search as S
from ..operators import state as T
from .text_queries import TERMS


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _values(s: SparkSession, rows: str, cols: str) -> DataFrame:
    return s.sql(f"SELECT * FROM VALUES {rows} AS t({cols})")


def _urls(s, d):
    return _t(s, d, "scrape_results").select("scrape_id", "url").distinct()


_HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"
_NORM = r"""(CASE WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(CASE WHEN regexp_matches(b, '^[a-z]+://[^/?]+$') THEN b || '/' ELSE b END, '/$', '') ELSE {0} END)"""


def _norm_sql(table: str, key: str, url: str = "url", extra: str = "") -> str:
    head = rf"regexp_extract(regexp_replace({url}, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)"
    return f"SELECT DISTINCT {key}, {url} AS u, lower({head}) || substring(regexp_replace({url}, '#.*$', ''), length({head}) + 1) AS b{extra} FROM {table}"


# ---------------------------------------------------------------- urls

IPS = "(1, '8.8.8.8'), (2, '127.0.0.1'), (3, '10.2.3.4'), (4, '172.31.0.9'), (5, '172.32.0.1'), (6, '192.168.1.1'), (7, '169.254.9.9'), (8, '100.64.0.1'), (9, '224.0.0.1'), (10, '255.255.255.255'), (11, '240.0.0.1'), (12, '203.0.113.7'), (13, '0.1.2.3'), (14, '1.1.1.1')"
_IPS_SQL = "(1, true), (2, false), (3, false), (4, false), (5, true), (6, false), (7, false), (8, false), (9, false), (10, false), (11, true), (12, false), (13, false), (14, true)"
V6 = "(1, '::1'), (2, '2606:4700::1111'), (3, '::ffff:10.0.0.1'), (4, '::ffff:8.8.8.8'), (5, 'fc00::1'), (6, 'fe80::1'), (7, 'ff02::1'), (8, '2002:0a00:0001::'), (9, '2002:0808:0808::'), (10, '64:ff9b::a00:1'), (11, '::')"
_V6_SQL = "(1, false), (2, true), (3, false), (4, true), (5, false), (6, false), (7, false), (8, false), (9, true), (10, false), (11, false)"


def _cidr(s, d):
    """Addresses that no private network holds: an anti join on the range, the networks being a fixed table."""
    nets = s.createDataFrame([(U._number(a), U._number(b)) for a, b in U.PRIVATE_V4], "lo bigint, hi bigint")
    ips = _values(s, IPS, "id, ip").withColumn("n", U.v4_number(F.col("ip")))
    return ips.join(F.broadcast(nets), F.col("n").between(F.col("lo"), F.col("hi")), "left_anti").select("id", "ip")


WRAPPED = "(1, 'https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1&rut=z'), (2, 'https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9iLmV4YW1wbGUvcA&x=1'), (3, 'https://r.search.yahoo.com/_ylt=A/RU=https%3a%2f%2fc.example%2fq/RK=2')"


def _unwrap(s, d):
    u = F.col("u")
    got = F.when(F.contains(u, F.lit("uddg=")), U.unwrap_param(u, "uddg")).when(F.contains(u, F.lit("/ck/a")), U.unwrap_base64(u)).otherwise(U.unwrap_path(u))
    return _values(s, WRAPPED, "id, u").select("id", got.alias("url"))


TEXTS = "(1, 'rust async book'), (2, 'a*b~c'), (3, 'ü/x@y'), (4, '')"


def _links(s, d):
    p = _t(s, d, "scrape_results").select("scrape_id", "url", "links").filter("scrape_id is not null").dropDuplicates(["scrape_id"])
    e = p.select("scrape_id", F.posexplode("links").alias("pos", "l")).select("scrape_id", "pos", "l.href", "l.text")
    first = F.row_number().over(Window.partitionBy("scrape_id", "href").orderBy("pos"))
    return e.filter("href is not null").withColumn("r", first).filter("r = 1").drop("r")


def _links_filtered(s, d, most=100):
    """At most `most` matching links of a page."""
    e = _links(s, d)
    good = F.contains(F.lower("href"), F.lit("an")) | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("an"))
    w = Window.partitionBy("scrape_id").orderBy("pos")
    text = F.when(F.coalesce("text", F.lit("")) == "", F.lit("(no text)")).otherwise(F.substring("text", 1, 100))
    return e.filter(good).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).select("scrape_id", "pos", "href", text.alias("text"))


_LINKS_SQL = """p AS (SELECT DISTINCT scrape_id, links FROM scrape_results WHERE links IS NOT NULL),
 e AS (SELECT scrape_id, i AS pos, links[i + 1].href AS href, links[i + 1].text AS text FROM p, LATERAL (SELECT unnest(range(len(links))) AS i)),
 l AS (SELECT scrape_id, pos::INT AS pos, href, text FROM (SELECT *, row_number() OVER (PARTITION BY scrape_id, href ORDER BY pos) AS r FROM e WHERE href IS NOT NULL) WHERE r = 1)"""


# ---------------------------------------------------------------- classification


def _lens(s, d):
    """Every record once; one without html has an empty response, which is judged like any other."""
    p = _t(s, d, "scrape_results").filter("scrape_id is not null").select("scrape_id", "clean_html", "markdown", "title", "links", "blocked", "page_type", "tier").dropDuplicates(["scrape_id"])
    p = p.fillna("", ["clean_html", "markdown", "tier"]).fillna("unknown", ["page_type"]).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    return (
        p.withColumn("vis", P.visible_bytes(F.col("clean_html"))).withColumn("scr", P.script_bytes(F.col("clean_html"))).withColumn("html_len", F.octet_length("clean_html").cast("bigint"))
        .withColumn("md_len", F.octet_length(F.btrim("markdown", F.lit(" \t\n\r"))).cast("bigint")).withColumn("n_links", F.coalesce(F.size("links"), F.lit(0)))
    )


_RAW_SQL = r"(?s)(<script.*?)(?:</script|\z)|(<style.*?)(?:</style|\z)"
_LENS_SQL = rf"""x AS (SELECT DISTINCT scrape_id, coalesce(clean_html, '') AS clean_html, coalesce(markdown, '') AS markdown, title, links, coalesce(blocked, false) AS blocked, coalesce(page_type, 'unknown') AS page_type, coalesce(tier, '') AS tier
 FROM scrape_results WHERE scrape_id IS NOT NULL),
 v AS (SELECT *, strlen(regexp_replace(regexp_replace(regexp_replace(lower(clean_html), '{_RAW_SQL}', '<', 'g'), '(?s)<[^>]*(>|\z)', '', 'g'), '[ \t\n\r\f]', '', 'g'))::BIGINT AS vis,
 coalesce(list_sum(list_transform(regexp_extract_all(lower(clean_html), '{_RAW_SQL}', 1), lambda y: strlen(y))), 0)::BIGINT
 + coalesce(list_sum(list_transform(regexp_extract_all(lower(clean_html), '{_RAW_SQL}', 2), lambda y: strlen(y))), 0)::BIGINT AS scr,
 strlen(clean_html)::BIGINT AS html_len, strlen(trim(markdown, E' \t\n\r'))::BIGINT AS md_len, coalesce(len(links), 0)::INT AS n_links FROM x)"""
_OK_SQL = """t AS (SELECT *, (md_len < 200 AND html_len > 2000) OR (vis < 100 AND html_len > 1500) OR md_len = 0 AS thin FROM v),
 o AS (SELECT *, (CASE WHEN blocked THEN false WHEN thin THEN page_type = 'list' AND md_len > 100 ELSE true END) OR (page_type = 'list' AND n_links > 10 AND md_len > 50) AS ok FROM t)"""

RESPONSES = """(1, 403, '<html>no</html>'), (2, 200, 'x'), (3, 200, concat('<title>Just a moment</title>', repeat('word ', 200))), (4, 200, concat('<p>', repeat('good text ', 200), '</p>')),
 (5, 200, concat('<script>', repeat('var a=1;', 200), '</script><p>', repeat('hello ', 20), '</p>')), (6, 429, ''), (7, 200, concat('<p>', repeat('words ', 200), '</p><div class=px-captcha>'))"""


def _block(s, d):
    return _values(s, RESPONSES, "id, status, html").select("id", P.block_reason(F.col("status"), F.col("html")).alias("reason"))


SERPS = "(1, 'ddg', 200, 'ok', 5), (2, 'bing', 429, '', 0), (3, 'ddg', 200, '<script src=anomaly.js>', 0), (4, 'yahoo', CAST(NULL AS INT), '', 0), (5, 'brave', 500, '', 0), (6, 'mojeek', 200, 'nothing', 0), (7, 'bing', 202, '', 0), (8, 'brave', 200, 'an anomaly of the captcha', 3), (9, 'yahoo', 200, '<div class=g-recaptcha>', 2), (10, 'bing', 200, 'x challenge-platform', 1)"


def _ok(s, d):
    """content_ok, note and next_action of every record; no fetch was escalated."""
    q = _lens(s, d)
    ok = P.content_ok(F.col("md_len"), F.col("vis"), F.col("html_len"), F.col("blocked"), F.lit(False), F.lit(None).cast("string"), F.col("page_type"), F.col("n_links"))
    notes = P.content_notes(F.col("ok"), F.col("blocked"), F.lit(False), F.col("tier"), F.lit(None).cast("string"), F.col("html_len"), F.col("page_type"))
    return q.withColumn("ok", ok).withColumn("x", notes).select("scrape_id", "ok", "x.note", "x.next_action")


# ---------------------------------------------------------------- search


def _hits(s, d):
    """Each distinct hit once, with the order of the engines and ranks inside its search."""
    h = _t(s, d, "search_hits").filter("url is not null").select("hit_id", "search_id", "query", "engine", "rank", F.coalesce("title", F.lit("")).alias("title"), "url", F.coalesce("snippet", F.lit("")).alias("snippet")).dropDuplicates(["hit_id"])
    return h.filter("search_id is not null")


def _seq():
    return F.struct(S.engine_order(F.col("engine")).alias("e"), F.col("engine"), F.col("rank"), F.col("hit_id"))


_ENGINE_SQL = "CASE engine " + " ".join(f"WHEN '{e}' THEN {i}" for i, e in enumerate(("ddg", "bing", "brave", "mojeek", "yahoo"), 1)) + " ELSE 6 END, engine, rank, hit_id"


def _fused(s, d):
    return S.fuse(_hits(s, d), "search_id", _seq())


_HITS_SQL = rf"""h0 AS (SELECT DISTINCT hit_id, search_id, query, engine, rank, coalesce(title, '') AS title, url, coalesce(snippet, '') AS snippet FROM search_hits WHERE url IS NOT NULL AND search_id IS NOT NULL),
 hn AS (SELECT *, regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS hd, regexp_replace(url, '#.*$', '') AS bare FROM h0),
 hb AS (SELECT *, lower(hd) || substring(bare, length(hd) + 1) AS b FROM hn),
 hp AS (SELECT *, CASE WHEN regexp_matches(b, '^[a-z]+://[^/?]+$') THEN b || '/' ELSE b END AS p FROM hb),
 hits AS (SELECT *, CASE WHEN hd = '' THEN url WHEN p LIKE '%/' AND length(p) > 8 THEN substring(p, 1, length(p) - 1) ELSE p END AS key,
 row_number() OVER (PARTITION BY search_id ORDER BY {_ENGINE_SQL}) AS seq FROM hp),
 f AS (SELECT search_id, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, arg_min(url, seq) AS url, coalesce(arg_min(snippet, seq) FILTER (snippet <> ''), '') AS snippet,
 min(seq) AS first_seq, count(*) AS votes FROM hits GROUP BY search_id, key),
 tt AS (SELECT search_id, key, title FROM (SELECT *, row_number() OVER (PARTITION BY search_id, key ORDER BY strlen(title) DESC, seq) AS r FROM hits) WHERE r = 1),
 fused AS (SELECT f.*, tt.title FROM f JOIN tt USING (search_id, key))"""

_STOP = ", ".join(f"'{w}'" for w in "vs versus and or the a an of to for in on with is are how what why best using use".split())
_RANK_SQL = _HITS_SQL + rf""", q AS (SELECT search_id, min(query) AS query FROM h0 GROUP BY search_id),
 qt AS (SELECT search_id, list_distinct(list_filter(list_transform(regexp_split_to_array(query, '\s+'), lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g'))),
 lambda w: strlen(w) >= 2 AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '\d+'))) AS terms FROM q),
 c AS (SELECT fused.*, CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(title || ' ' || snippet || ' ' || url), t)))::DOUBLE / len(terms) ELSE 0 END AS cov FROM fused JOIN qt USING (search_id)),
 ranked AS (SELECT *, round(10 * cov + rrf - CASE WHEN regexp_matches({_HOST.format('url')}, 'youtube\.com|youtu\.be|pinterest\.|facebook\.com|tiktok\.com|quora\.com') THEN 0.5::DOUBLE ELSE 0::DOUBLE END, 9) AS score FROM c),
 zc AS (SELECT * FROM (SELECT *, count(*) FILTER (cov > 0) OVER (PARTITION BY search_id) AS nz FROM ranked) WHERE nz < 3 OR cov > 0),
 best AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, first_seq) AS pos FROM zc)"""


def _terms(s, d):
    """(fused hits with the terms of their search, the terms column)."""
    from ..functions.text import query_terms

    q = _hits(s, d).groupBy("search_id").agg(F.min("query").alias("query"))
    return _fused(s, d).join(q.select("search_id", query_terms(F.col("query")).alias("terms")), "search_id"), F.col("terms")


def _ranked(s, d):
    return S.drop_uncovered(S.reranked(*_terms(s, d)), "search_id")


def _search(s, d):
    return S.top(_ranked(s, d), "search_id", 10).select("search_id", "pos", "key", "url", "title", "score")


def _site_search(s, d):
    """The search kept to one host suffix and without another."""
    r = S.for_sites(S.reranked(*_terms(s, d)), "url", None, SKIPPED)
    return S.top(S.drop_uncovered(r, "search_id"), "search_id", 10).select("search_id", "pos", "key", "score")


#: Hosts that site_search leaves out.
SKIPPED = ("blog.nulond-ga.example", "www.sedarm-be.example")


def _warning(s, d):
    """The warning is judged before hits without any term are dropped; every engine that gave hits is ok."""
    first = S.top(S.reranked(*_terms(s, d)), "search_id", 1)
    n = _hits(s, d).filter("engine is not null").groupBy("search_id", "engine").agg(F.count(F.lit(1)).alias("n"))
    one = F.struct(S.engine_order(F.col("engine")).alias("o"), F.concat("engine", F.lit(":ok:"), F.col("n").cast("string")).alias("s"))
    ok = n.groupBy("search_id").agg(F.count(F.lit(1)).alias("ok"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["s"]).alias("engines"))
    return first.join(ok, "search_id").select("search_id", S.low_relevance(F.col("cov"), F.col("terms"), F.col("ok"), F.col("engines")).alias("warning"))


def _effective(s, d):
    """Each search's query as it goes out with a site, exclusions and a period; the parameters follow from the id."""
    q = _t(s, d, "search_results").filter("search_id is not null and query is not null")
    site = F.when(F.pmod("search_id", F.lit(3)) == 0, F.lit(" a.example "))
    out = F.when(F.pmod("search_id", F.lit(2)) == 0, F.array(F.lit("b.example"), F.lit(" "), F.lit(" c.example")))
    fresh = F.element_at(F.array(F.lit("Day "), F.lit("year"), F.lit("decade"), F.lit("")), (F.pmod("search_id", F.lit(4)) + 1).cast("int"))
    text = S.effective_query(F.col("query"), site, out, fresh)
    return q.select("search_id", text.alias("text"), U.encode_query(text).alias("q")).distinct()


# ---------------------------------------------------------------- crawl


def _site_edges(s, d):
    """Links that a crawl may follow, from the normalized address of a record to that of the link's target, each once;
    a target that is no record is a leaf.  The focus terms in the anchor score a link."""
    p = _t(s, d, "scrape_results").filter("scrape_id is not null and url is not null").select("scrape_id", "url", "links").dropDuplicates(["scrape_id"])
    e = p.select("scrape_id", F.col("url").alias("src"), F.posexplode("links").alias("pos", "l"))
    e = e.select("scrape_id", "src", "pos", U.absolute(F.col("l.href"), F.col("src")).alias("dst"), F.lower(F.coalesce("l.text", F.lit(""))).alias("anchor"))
    e = C.candidates(e).select(U.normalize(F.col("src")).alias("src"), U.normalize(F.col("dst")).alias("dst"), C.link_score(F.col("anchor"), list(TERMS)).alias("score"), F.struct("scrape_id", "pos").alias("pos"))
    return e.filter("src <> dst").groupBy("src", "dst").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))


def _site_bfs(s, d, depth=2):
    """(node, depth) from one seed a site, the address of its first record."""
    p = _t(s, d, "scrape_results").filter("scrape_id is not null and site is not null and url is not null")
    return C.bfs(_site_edges(s, d), p.groupBy("site").agg(F.min_by("url", "scrape_id").alias("url")).select(U.normalize(F.col("url")).alias("node")), depth)


def _crawl_parts(s, d):
    """(links, pages, seeds) of the crawl operators: a page that a link names is found by its normalized address."""
    p = _t(s, d, "scrape_results").filter("scrape_id is not null and url is not null")
    pages = p.groupBy(U.normalize(F.col("url")).alias("url")).agg(F.max(F.length(F.coalesce("markdown", F.lit("")))).cast("bigint").alias("chars"))
    seeds = p.filter("site is not null").groupBy(F.col("site").alias("seed")).agg(F.min_by("url", "scrape_id").alias("url"))
    return _site_edges(s, d), pages, seeds.select("seed", U.normalize(F.col("url")).alias("url"))


def _crawl(s, d):
    """A crawl from one seed a site: pages in the order of fetching, within pages and characters; leaves count as failed."""
    links, pages, seeds = _crawl_parts(s, d)
    return C.crawl(links, pages, seeds, 2, 5, 20_000)


def _discovered(s, d):
    links, _, seeds = _crawl_parts(s, d)
    return C.discover(links, seeds, 1, 10)


def _sitemap_crawl(s, d):
    """Each site's records as its sitemap, in order of their ids."""
    p = _t(s, d, "scrape_results").filter("scrape_id is not null and site is not null and url is not null").select(F.col("site").alias("seed"), U.normalize(F.col("url")).alias("url"), F.col("scrape_id").alias("ord"))
    return C.crawl_sitemap(p, _crawl_parts(s, d)[1], 5, 10_000)


def _norm_expr(u: str) -> str:
    """normalize() of a SQL expression."""
    bare = f"regexp_replace({u}, '#.*$', '')"
    head = f"regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)"
    low = f"(lower({head}) || substring({bare}, length({head}) + 1))"
    path = f"(CASE WHEN regexp_matches({low}, '^[a-z]+://[^/?]+$') THEN {low} || '/' ELSE {low} END)"
    return f"(CASE WHEN {head} = '' THEN {u} WHEN {path} LIKE '%/' AND length({path}) > 8 THEN substring({path}, 1, length({path}) - 1) ELSE {path} END)"


#: Links of the tables are absolute or fragments.
_SITE_SQL = f"""p AS (SELECT DISTINCT scrape_id, site, url, links, markdown FROM scrape_results WHERE scrape_id IS NOT NULL AND url IS NOT NULL),
 le AS (SELECT scrape_id, url AS s, i AS pos, links[i + 1].href AS t, lower(coalesce(links[i + 1].text, '')) AS a FROM p, LATERAL (SELECT unnest(range(len(links))) AS i)),
 lf AS (SELECT scrape_id, pos, {_norm_expr('s')} AS src, {_norm_expr('t')} AS dst, {' + '.join(f"contains(a, '{x}')::INT" for x in TERMS)} AS score FROM le
 WHERE regexp_matches(t, '^https?://') AND NOT contains(t, '#') AND NOT regexp_matches(t, '[.](pdf|jpg|png)$') AND {_HOST.format('s')} = {_HOST.format('t')}),
 edges AS (SELECT src, dst, max(score) AS score, min({{'scrape_id': scrape_id, 'pos': pos}}) AS pos FROM lf WHERE src <> dst GROUP BY src, dst),
 pg AS (SELECT {_norm_expr('url')} AS url, max(length(coalesce(markdown, '')))::BIGINT AS chars FROM p GROUP BY 1),
 seeds AS (SELECT site AS seed, {_norm_expr('arg_min(url, scrape_id)')} AS url FROM p WHERE site IS NOT NULL GROUP BY site),
 k AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, pos) AS r FROM edges) WHERE r <= 10),
 s0 AS (SELECT DISTINCT url AS node, 0 AS depth FROM seeds),
 s1 AS (SELECT DISTINCT dst AS node, 1 AS depth FROM k JOIN s0 ON k.src = s0.node WHERE dst NOT IN (SELECT node FROM s0)),
 s2 AS (SELECT DISTINCT dst AS node, 2 AS depth FROM k JOIN s1 ON k.src = s1.node WHERE dst NOT IN (SELECT node FROM s0 UNION ALL SELECT node FROM s1))"""


def _budget(s, d):
    p = _t(s, d, "scrape_results").filter("markdown <> '' and scrape_id is not null").select("scrape_id", "site", F.length("markdown").cast("bigint").alias("n")).distinct()
    return C.within_budget(p, "site", "scrape_id", "n", 20_000).select("site", "scrape_id", "used")


SITEMAPS = "('a.example', '<urlset><loc> https://a.example/x </loc><loc>https://b.example/y</loc></urlset>'), ('a.example', '<loc>https://a.example/x</loc><loc>https://a.example/z</loc>'), ('b.example', '<loc>http://b.example/</loc>')"


# ---------------------------------------------------------------- state


def _events(s, d):
    return _t(s, d, "events")


def _ms(c):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) div 1000")


def _cooling(s, d):
    e = _events(s, d).select("event_id", "event_type", _ms("ts").alias("ms"), (F.pmod("event_id", F.lit(17)) == 0).alias("blocked"))
    return T.cooling(e, "event_type", "ms", "blocked", "event_id", F.lit(120_000)).select("event_id", "until_ms", "skip")


COOLED = "('a', 'ddg', 500, 1), ('a', 'bing', 400, 2), ('a', 'brave', 900, 3), ('b', 'ddg', 50, 1), ('b', 'bing', 400, 2)"

QUERIES = {
    "url_normalize": lambda s, d: _urls(s, d).select("scrape_id", "url", U.normalize(F.col("url")).alias("norm")),
    "url_host": lambda s, d: _urls(s, d).select("scrape_id", "url", U.host_of(F.col("url")).alias("host")),
    "url_validate": lambda s, d: _urls(s, d).select("scrape_id", "url", U.valid(F.col("url")).alias("ok")),
    "url_dedupe": lambda s, d: _urls(s, d).groupBy(U.normalize(F.col("url")).alias("norm")).agg(F.min("scrape_id").alias("first_id"), F.count(F.lit(1)).alias("n")),
    "is_pdf_url": lambda s, d: _values(s, "(1, 'http://a.example/X.PDF?z=1'), (2, 'http://a.example/pdf'), (3, 'http://a.example/a.pdf#p')", "id, url").select("id", U.is_pdf(F.col("url")).alias("pdf")),
    "ip_public_v4": lambda s, d: _values(s, IPS, "id, ip").select("id", U.public_v4(F.col("ip")).alias("public")),
    "ip_public_v6": lambda s, d: _values(s, V6, "id, ip").select("id", U.public_ip(F.col("ip")).alias("public")),
    "ip_cidr_anti": _cidr,
    "unwrap_redirects": _unwrap,
    "query_encode": lambda s, d: _values(s, TEXTS, "id, t").select("id", U.encode_query(F.col("t")).alias("q"), U.encode_path(F.col("t")).alias("p")),
    "pct_decode": lambda s, d: _values(s, "(1, 'a%20b'), (2, '%zz%41'), (3, '%C3%BC')", "id, t").select("id", U.decode_percent(F.col("t")).alias("text")),
    "repo_spec": lambda s, d: _values(s, "(1, 'a/b'), (2, 'https://github.com/a/b.git'), (3, 'nope'), (4, 'git@github.com:x/y.git'), (5, 'https://github.com/a/b/tree/main')", "id, t").select("id", U.repo_spec(F.col("t"))["owner"].alias("owner"), U.repo_spec(F.col("t"))["repo"].alias("repo")),
    "url_join": lambda s, d: _values(s, "(1, '/x', 'https://a.example/p/q'), (2, 'y?z=1', 'https://a.example/p/q'), (3, '#top', 'https://a.example/'), (4, '/für', 'https://a.example/')", "id, h, b").select("id", U.absolute(F.col("h"), F.col("b")).alias("url")),
    "site_include": lambda s, d: _urls(s, d).filter(U.host_matches(U.host_of(F.col("url")), F.lit("droldorkol-hub.example"))).select("scrape_id"),
    "site_exclude": lambda s, d: _urls(s, d).withColumn("host", U.host_of(F.col("url"))).join(
        F.broadcast(_values(s, "('droldorkol-hub.example'), ('blog.nulond-ga.example')", "site")), U.host_matches(F.col("host"), F.col("site")), "left_anti"
    ).select("scrape_id"),
    "demoted_junk": lambda s, d: _values(s, "(1, 'https://www.facebook.com/x'), (2, 'https://a.example/'), (3, 'https://duckduckgo.com/y.js?ad'), (4, 'https://search.yahoo.com/x'), (5, 'nourl'), (6, 'https://news.yahoo.com/a'), (7, 'https://youtu.be/x'), (8, 'https://medium.com/a')", "id, url").select("id", S.demoted(F.col("url")).alias("demoted"), U.junk(F.col("url")).alias("junk")),
    "page_links": _links,
    "page_links_filtered": _links_filtered,
    "visible_script_len": lambda s, d: _lens(s, d).select("scrape_id", "vis", "scr"),
    "block_reason": _block,
    "serp_status": lambda s, d: _values(s, SERPS, "id, engine, status, html, n").select("id", P.serp_status(F.col("engine"), F.col("status"), F.col("html"), F.col("n")).alias("line")),
    "content_ok": _ok,
    "quality_score": lambda s, d: _lens(s, d).select("scrape_id", F.round(P.quality_score(F.col("vis"), F.col("html_len"), F.octet_length(F.coalesce("title", F.lit(""))), F.col("n_links")), 6).alias("score")),
    "page_type": lambda s, d: _values(s, "(1, 12, 500, 900, 10, 'x'), (2, 0, 0, 300, 0, '![a](b)'), (3, 2, 10, 900, 800, 'x'), (4, 0, 0, 20, 0, 'x')", "id, l, lt, t, pt, md").select("id", P.page_type(F.col("l"), F.col("lt"), F.col("t"), F.col("pt"), F.col("md")).alias("kind")),
    "serp_rank": lambda s, d: _hits(s, d).withColumn("pos", F.row_number().over(Window.partitionBy("search_id", "engine").orderBy("rank", "hit_id")) - 1).select("hit_id", "pos"),
    "rrf_fuse": lambda s, d: _fused(s, d).select("search_id", "key", "rrf", "url", "snippet", "title", "votes"),
    "coverage_rerank": lambda s, d: _ranked(s, d).select("search_id", "key", "cov", "score"),
    "search_full": _search,
    "search_sites": _site_search,
    "effective_query": _effective,
    "low_relevance": _warning,
    "link_graph": lambda s, d: _site_edges(s, d).select("src", "dst", "score", "pos.scrape_id", "pos.pos"),
    "crawl_level1": lambda s, d: _site_bfs(s, d, 1),
    "crawl_bfs": _site_bfs,
    "site_crawl": _crawl,
    "site_discover": _discovered,
    "sitemap_crawl": _sitemap_crawl,
    "crawl_budget": _budget,
    "sitemap_urls": lambda s, d: C.sitemap_urls(_values(s, SITEMAPS, "host, xml"), "xml", "host"),
    "cache_ttl_hits": lambda s, d: T.cache_hits(_events(s, d), "user_id", "ts", "event_id").select("event_id", "hit"),
    "cache_lru_evict": lambda s, d: T.kept_entries(_events(s, d), "user_id", "ts", 50),
    "pacing_sleep": lambda s, d: T.pacing(_events(s, d), "event_type", "ts", "event_id").select("event_id", "sleep_ms"),
    "cooldown_skip": _cooling,
    "cooldown_bypass": lambda s, d: T.bypass(_values(s, COOLED, "grp, engine, until, ord"), F.lit(100), "until", "ord").select("grp", "engine"),
    "bench_rollup": lambda s, d: _events(s, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean")),
    "fetch_stats_rollup": lambda s, d: _t(s, d, "fetch_stats").dropDuplicates(["stat_id"]).groupBy("op", "cache").agg(F.count(F.lit(1)).alias("calls"), F.sum("bytes_down").alias("bytes"), F.sum("chars_out").alias("chars"), F.sum("est_tokens").alias("tokens"), F.sum("dropped_paras").alias("dropped")),
}

SQL = {
    "url_normalize": rf"WITH t AS ({_norm_sql('scrape_results', 'scrape_id')}), p AS (SELECT *, CASE WHEN regexp_matches(b, '^[a-z]+://[^/?]+$') THEN b || '/' ELSE b END AS p FROM t) SELECT scrape_id, u AS url, CASE WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN u WHEN p LIKE '%/' AND length(p) > 8 THEN substring(p, 1, length(p) - 1) ELSE p END AS norm FROM p",
    "url_host": f"SELECT DISTINCT scrape_id, url, {_HOST.format('url')} AS host FROM scrape_results",
    "url_validate": r"SELECT DISTINCT scrape_id, url, regexp_matches(url, '(?i)^https?://[^/?#\s]+') AS ok FROM scrape_results",
    "url_dedupe": rf"WITH t AS ({_norm_sql('scrape_results', 'scrape_id')}), p AS (SELECT *, CASE WHEN regexp_matches(b, '^[a-z]+://[^/?]+$') THEN b || '/' ELSE b END AS p FROM t) SELECT CASE WHEN p LIKE '%/' AND length(p) > 8 THEN substring(p, 1, length(p) - 1) ELSE p END AS norm, min(scrape_id) AS first_id, count(*) AS n FROM p GROUP BY 1",
    "is_pdf_url": "SELECT * FROM (VALUES (1, true), (2, false), (3, true)) t(id, pdf)",
    "ip_public_v4": f"SELECT * FROM (VALUES {_IPS_SQL}) t(id, public)",
    "ip_public_v6": f"SELECT * FROM (VALUES {_V6_SQL}) t(id, public)",
    "ip_cidr_anti": "SELECT * FROM (VALUES (1, '8.8.8.8'), (5, '172.32.0.1'), (11, '240.0.0.1'), (14, '1.1.1.1')) t(id, ip)",
    "unwrap_redirects": "SELECT * FROM (VALUES (1, 'https://a.example/x?y=1'), (2, 'https://b.example/p'), (3, 'https://c.example/q')) t(id, url)",
    "query_encode": "SELECT * FROM (VALUES (1, 'rust+async+book', 'rust%20async%20book'), (2, 'a%2Ab~c', 'a%2Ab~c'), (3, '%C3%BC%2Fx%40y', '%C3%BC%2Fx@y'), (4, '', '')) t(id, q, p)",
    "pct_decode": "SELECT * FROM (VALUES (1, 'a b'), (2, '%zzA'), (3, 'ü')) t(id, text)",
    "repo_spec": "SELECT * FROM (VALUES (1, 'a', 'b'), (2, 'a', 'b'), (3, NULL, NULL), (4, 'x', 'y'), (5, 'a', 'b')) t(id, owner, repo)",
    "url_join": "SELECT * FROM (VALUES (1, 'https://a.example/x'), (2, 'https://a.example/p/y?z=1'), (3, NULL), (4, 'https://a.example/f%C3%BCr')) t(id, url)",
    "site_include": f"SELECT DISTINCT scrape_id FROM scrape_results WHERE regexp_replace({_HOST.format('url')}, '^www\\.', '') = 'droldorkol-hub.example' OR {_HOST.format('url')} LIKE '%.droldorkol-hub.example'",
    "site_exclude": f"SELECT DISTINCT scrape_id FROM scrape_results WHERE NOT (regexp_replace({_HOST.format('url')}, '^www\\.', '') IN ('droldorkol-hub.example', 'blog.nulond-ga.example') OR {_HOST.format('url')} LIKE '%.droldorkol-hub.example' OR {_HOST.format('url')} LIKE '%.blog.nulond-ga.example')",
    "demoted_junk": "SELECT * FROM (VALUES (1, true, false), (2, false, false), (3, false, true), (4, false, true), (5, false, true), (6, false, false), (7, true, false), (8, false, false)) t(id, demoted, junk)",
    "page_links": f"WITH {_LINKS_SQL} SELECT * FROM l",
    "page_links_filtered": f"WITH {_LINKS_SQL} SELECT scrape_id, pos, href, CASE WHEN coalesce(text, '') = '' THEN '(no text)' ELSE substring(text, 1, 100) END AS text FROM (SELECT *, row_number() OVER (PARTITION BY scrape_id ORDER BY pos) AS r FROM l WHERE contains(lower(href), 'an') OR contains(lower(coalesce(text, '')), 'an')) WHERE r <= 100",
    "visible_script_len": f"WITH {_LENS_SQL} SELECT scrape_id, vis, scr FROM v",
    "block_reason": "SELECT * FROM (VALUES (1, 'HTTP 403 from origin'), (2, 'near-empty response body'), (3, 'bot interstitial text'), (4, NULL), (5, 'thin body dominated by scripts (100B text vs 1608B script) - challenge page or client-rendered shell'), (6, 'HTTP 429 from origin'), (7, 'PerimeterX challenge page')) t(id, reason)",
    "serp_status": "SELECT * FROM (VALUES (1, 'ddg:ok:5'), (2, 'bing:blocked:http429'), (3, 'ddg:blocked:anomaly'), (4, 'yahoo:timeout'), (5, 'brave:error:http500'), (6, 'mojeek:empty'), (7, 'bing:blocked:http202'), (8, 'brave:ok:3'), (9, 'yahoo:blocked:captcha'), (10, 'bing:blocked:cloudflare')) t(id, line)",
    "content_ok": f"""WITH {_LENS_SQL}, {_OK_SQL} SELECT scrape_id, ok, CASE WHEN ok THEN NULL WHEN blocked THEN 'bot protection not bypassed (tier ' || tier || ', blocked); no article recovered'
 ELSE 'no article extracted from ' || html_len::VARCHAR || ' bytes of HTML (app shell, index, or media page) - type: ' || page_type END AS note,
 CASE WHEN ok THEN NULL WHEN blocked THEN 'site likely uses DataDome/Turnstile/Akamai, which no free tool bypasses - try another path on this domain or a different source'
 ELSE 'page has no prose to extract - try a specific article URL' END AS next_action FROM o""",
    "quality_score": f"""WITH {_LENS_SQL} SELECT scrape_id, round(CASE WHEN vis <= 0 THEN 0::DOUBLE ELSE least(1::DOUBLE, 0.4::DOUBLE * least(5.0::DOUBLE * vis / greatest(html_len, 1), 1::DOUBLE) + 0.3::DOUBLE * least(vis / 5000.0::DOUBLE, 1::DOUBLE)
 + CASE WHEN strlen(coalesce(title, '')) > 5 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN n_links > 0 AND n_links < 50 THEN 0.15::DOUBLE ELSE 0 END) END, 6) AS score FROM v""",
    "page_type": "SELECT * FROM (VALUES (1, 'list'), (2, 'media'), (3, 'article'), (4, 'unknown')) t(id, kind)",
    "serp_rank": f"WITH {_HITS_SQL} SELECT hit_id, (row_number() OVER (PARTITION BY search_id, engine ORDER BY rank, hit_id) - 1)::INT AS pos FROM h0",
    "rrf_fuse": f"WITH {_HITS_SQL} SELECT search_id, key, rrf, url, snippet, title, votes FROM fused",
    "coverage_rerank": f"WITH {_RANK_SQL} SELECT search_id, key, cov, score FROM zc",
    "search_full": f"WITH {_RANK_SQL} SELECT search_id, pos::INT AS pos, key, url, title, score FROM best WHERE pos <= 10",
    "low_relevance": f"""WITH {_RANK_SQL}, n AS (SELECT search_id, engine, count(*) AS n FROM h0 WHERE engine IS NOT NULL GROUP BY search_id, engine),
 ok AS (SELECT search_id, count(*) AS ok, string_agg(engine || ':ok:' || n::VARCHAR, ',' ORDER BY {_ENGINE_SQL.replace(', rank, hit_id', '')}) AS engines FROM n GROUP BY search_id),
 fst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, first_seq) AS pos FROM ranked) WHERE pos = 1)
 SELECT search_id, CASE WHEN len(terms) > 0 AND NOT (cov >= 0.5 AND ok >= 2) THEN 'low relevance: top hits cover ' || round(cov * len(terms))::INT::VARCHAR || '/' || len(terms)::VARCHAR || ' query terms; engines: ' || engines
 || ' — retry later, rephrase with fewer terms, or fetch known URLs' END AS warning FROM fst JOIN ok USING (search_id) JOIN qt USING (search_id)""",
    "effective_query": """WITH e AS (SELECT DISTINCT search_id, query || CASE WHEN search_id % 3 = 0 THEN ' site:a.example' ELSE '' END || CASE WHEN search_id % 2 = 0 THEN ' -site:b.example -site:c.example' ELSE '' END
 || CASE search_id % 4 WHEN 0 THEN ' when:day' WHEN 1 THEN ' when:year' ELSE '' END AS text FROM search_results WHERE search_id IS NOT NULL AND query IS NOT NULL)
 SELECT search_id, text, replace(replace(url_encode(text), '%20', '+'), '*', '%2A') AS q FROM e""",
    "search_sites": f"""WITH {_RANK_SQL}, r2 AS (SELECT * FROM ranked WHERE NOT (regexp_replace({_HOST.format('url')}, '^www\\.', '') IN ('blog.nulond-ga.example', 'sedarm-be.example') OR {_HOST.format('url')} LIKE '%.blog.nulond-ga.example' OR {_HOST.format('url')} LIKE '%.sedarm-be.example')),
 z2 AS (SELECT * FROM (SELECT *, count(*) FILTER (cov > 0) OVER (PARTITION BY search_id) AS nz FROM r2) WHERE nz < 3 OR cov > 0)
 SELECT search_id, pos::INT AS pos, key, score FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY score DESC, first_seq) AS pos FROM z2) WHERE pos <= 10""",
    "link_graph": f"WITH {_SITE_SQL} SELECT src, dst, score::INT AS score, pos.scrape_id AS scrape_id, pos.pos::INT AS pos FROM edges",
    "crawl_level1": f"WITH {_SITE_SQL} SELECT * FROM s0 UNION ALL SELECT * FROM s1",
    "crawl_bfs": f"WITH {_SITE_SQL} SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2",
    "site_discover": f"""WITH {_SITE_SQL}, a AS (SELECT seed, url, 0 AS l FROM seeds), b AS (SELECT DISTINCT seed, dst AS url, 1 AS l FROM a JOIN edges ON src = url WHERE (seed, dst) NOT IN (SELECT (seed, url) FROM a))
 SELECT seed, url FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY l, url) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE r <= 10""",
    "sitemap_crawl": f"""WITH {_SITE_SQL}, m AS (SELECT site AS seed, {_norm_expr('url')} AS url, min(scrape_id) AS ord FROM p WHERE site IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY ord) AS r FROM m) WHERE r <= 5),
 g AS (SELECT seed, f.url, ord, pg.chars IS NOT NULL AS ok, coalesce(pg.chars, 0) AS chars, coalesce(sum(pg.chars) OVER (PARTITION BY seed ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM f LEFT JOIN pg ON f.url = pg.url)
 SELECT seed, url, ord, ok, chars FROM g WHERE c < 10000""",
    "crawl_budget": """WITH p AS (SELECT DISTINCT scrape_id, site, length(markdown)::BIGINT AS n FROM scrape_results WHERE markdown <> '' AND scrape_id IS NOT NULL),
 w AS (SELECT site, scrape_id, coalesce(sum(n) OVER (PARTITION BY site ORDER BY scrape_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM p) SELECT * FROM w WHERE used < 20000""",
    "sitemap_urls": "SELECT * FROM (VALUES ('a.example', 'https://a.example/x'), ('a.example', 'https://a.example/z'), ('b.example', 'http://b.example/')) t(host, url)",
    "cache_ttl_hits": "SELECT event_id, coalesce(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) < 3600000000, false) AS hit FROM events",
    "cache_lru_evict": "SELECT user_id, max(ts) AS last FROM events GROUP BY user_id ORDER BY last DESC, user_id LIMIT 50",
    "pacing_sleep": """WITH g AS (SELECT event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id), ts) // 1000 AS gap FROM events)
 SELECT event_id, CASE WHEN gap IS NULL OR gap < 0 THEN 0 ELSE least(1500, greatest(0, 1100 - gap)) END::BIGINT AS sleep_ms FROM g""",
    "cooldown_skip": """WITH e AS (SELECT event_id, event_type, date_diff('microsecond', TIMESTAMP '1970-01-01', ts) // 1000 AS ms, event_id % 17 = 0 AS blocked FROM events),
 u AS (SELECT event_id, ms, max(CASE WHEN blocked THEN ms + 120000 END) OVER (PARTITION BY event_type ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until_ms FROM e)
 SELECT event_id, until_ms, coalesce(until_ms > ms, false) AS skip FROM u""",
    "cooldown_bypass": "SELECT * FROM (VALUES ('a', 'bing'), ('a', 'ddg'), ('b', 'ddg')) t(grp, engine)",
    "bench_rollup": "SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY event_type",
    "fetch_stats_rollup": "SELECT op, cache, count(*) AS calls, sum(bytes_down)::BIGINT AS bytes, sum(chars_out)::BIGINT AS chars, sum(est_tokens)::BIGINT AS tokens, sum(dropped_paras)::BIGINT AS dropped FROM (SELECT DISTINCT * FROM fetch_stats) GROUP BY op, cache",
}
