"""Invariants of text functions, extraction and streaming state."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brookweave.functions import text as T
from brookweave.functions import urls as U
from brookweave.operators import crawl, extract, markdown
from brookweave.operators import state as batch_state
from brookweave.plans import registry
from brookweave.streaming import state as stream_state

TEXTS = st.lists(st.text(alphabet="ab \n`~é日", max_size=60), min_size=1, max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_cutting_and_joining_gives_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.truncate(F.col("t"), 7).alias("a")).withColumn("r", T.slice_at(F.col("t"), F.length("a"))).collect()
    for r in rows:
        assert r["a"] + r["r"] == r["t"] and len(r["a"]) <= 7


def test_walk_gives_every_page_of_the_cut(spark, tmp_path):
    texts = ["", "é" * 1201, "a" * 599 + "\n\n日" * 300, "\n".join("word " * (k % 90) for k in range(200)), "x" * 600, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in sorted(registry.queries()["page_walk_all"](spark, str(tmp_path)).collect(), key=lambda r: (r["doc_id"], r["page_no"])):
        assert r["offset"] == sum(got.setdefault(r["doc_id"], []))
        got[r["doc_id"]].append(r["length"])
        assert (r["next_offset"] or len(texts[r["doc_id"]].replace("\n", "\n\n"))) == sum(got[r["doc_id"]])
    assert set(got) == {1, 2, 3, 4} and got[1] == [600, 600, 1] and got[4] == [600] and len(got[3]) > 60
    left = [(k, texts[k].replace("\n", "\n\n"), 0) for k in got]
    for _ in range(4):
        df = spark.createDataFrame(left, "k int, t string, page int").withColumn("n", F.length(T.truncate(F.col("t"), 600)))
        rows = df.collect()
        assert [r["n"] for r in rows] == [got[r["k"]][r["page"]] for r in rows]
        left = [(r["k"], r["t"][r["n"] :], r["page"] + 1) for r in rows if r["n"] < len(r["t"])]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_closed_fences_stay_closed(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.close_fence(F.col("t")).alias("c"))
    assert all(r[0] == 0 for r in df.select(T.fence_state(F.col("c"))["len"]).collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_paragraphs_join_to_the_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.array_join(T.paragraphs(F.col("t")), "\n\n").alias("j"))
    assert all(r["t"] == r["j"] for r in df.collect())


def test_normalize_twice_is_once(spark):
    urls = ["HTTP://A.example/X/#f", "https://a.example", "nothing", "https://a.example/p?q=1#z", "https://a.example/b/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(U.normalize(F.col("u")).alias("n"))
    assert all(r[0] == r[1] for r in df.select("n", U.normalize(F.col("n"))).collect())


def test_extract_survives_odd_html():
    assert extract.extract(None, None)["markdown"] == ""
    assert extract.extract("<p>a<p>b</x></p>", "u")["markdown"] == "a\n\nb"
    deep = "<div>" * 3000 + "deep text" + "</div>" * 3000
    assert "deep text" in extract.extract(deep, "https://a.example/")["markdown"]


def test_markdown_folds_keep_code():
    assert markdown.clean("```\n---\n\n\n\nx   y\n```") == "```\n---\n\n\n\nx   y\n```"
    assert markdown.clean(None) is None and markdown.clean_readme("") == ""
    assert "<!-- kept -->" in markdown.clean_readme("```\n<!-- kept -->\n```")


def test_crawl_follows_levels_once(spark):
    edges = spark.createDataFrame([(1, 2, 0, 0), (2, 3, 0, 1), (3, 1, 0, 2), (3, 4, 0, 3)], "src int, dst int, score int, pos int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert {tuple(r) for r in crawl.bfs(edges, seeds, 3).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_site_crawl_reads_the_addresses(spark, tmp_path):
    n = 1200  # more pages than the synthetic graph has nodes
    link = lambda h, t="x": {"href": h, "text": t}
    pages = [(1, "a.example", "https://A.example/", [link(f"/p{k}") for k in range(11)] + [link("/q#z"), link("/d.pdf"), link("https://b.example/"), link("/late", "Valve list")])]
    pages += [(2, "a.example", "https://a.example/p3/", [link("deep"), link("/")]), (3, "b.example", "https://b.example/", None), (4, None, None, [link("/n")])]
    pages += [(k, f"s{k}.example", f"https://s{k}.example/", [link("/one")]) for k in range(10, n)]
    spark.createDataFrame(pages + pages[:1], "scrape_id bigint, site string, url string, links array<struct<href string, text string>>").write.parquet(f"{tmp_path}/scrape_results.parquet")
    q = registry.queries()
    graph = q["link_graph"](spark, str(tmp_path)).collect()
    assert len(graph) == 12 + 2 + n - 10 and ("https://a.example/p3", "https://a.example/p3/deep") in {(r["src"], r["dst"]) for r in graph}
    found = {r["node"]: r["depth"] for r in q["crawl_bfs"](spark, str(tmp_path)).collect() if "//a." in r["node"]}
    assert found == {"https://a.example": 0, "https://a.example/late": 1, **{f"https://a.example/p{k}": 1 for k in range(9)}, "https://a.example/p3/deep": 2}
    assert q["crawl_level1"](spark, str(tmp_path)).count() == 1 + 1 + 10 + 2 * (n - 10)


def test_matching_links_up_to_a_hundred(spark, tmp_path):
    pages = [(1, [{"href": f"/an{k}", "text": None} for k in range(104)] + [{"href": "/an3", "text": "x"}]), (2, [{"href": "/b", "text": "Many"}, {"href": "/c", "text": "x"}]), (3, None)]
    df = spark.createDataFrame(pages, "scrape_id bigint, links array<struct<href string, text string>>").withColumn("url", F.lit("https://a.example/"))
    df.write.parquet(f"{tmp_path}/scrape_results.parquet")
    got = {(r["scrape_id"], r["pos"]) for r in registry.queries()["page_links_filtered"](spark, str(tmp_path)).collect()}
    assert got == {(1, k) for k in range(100)} | {(2, 0)}


def test_literal_rules_run_over_whole_columns(spark, sf):
    q, t = registry.queries(), lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    pages = t("scrape_results").filter("scrape_id is not null").dropDuplicates(["scrape_id"])
    texts = {r[0]: r[1] for r in pages.filter("markdown is not null").select("scrape_id", "markdown").collect()}
    for name in ("fence_close_all", "fence_state_all", "table_artifact_all", "readme_clean_all"):
        assert q[name](spark, sf).count() == len(texts) > 20
    parts = {}
    for r in sorted(q["paragraphs_all"](spark, sf).collect(), key=lambda r: (r["scrape_id"], r["i"])):
        parts.setdefault(r["scrape_id"], []).append(r["p"])
    assert {k: "\n\n".join(v) for k, v in parts.items()} == texts
    assert q["page_type_all"](spark, sf).count() == pages.filter("clean_html is not null").count()
    assert q["escaping_all"](spark, sf).count() == pages.filter("title is not null").count()
    assert q["url_join_all"](spark, sf).count() == pages.selectExpr("explode(links)").count()
    for name in ("query_terms_all", "focus_query_words_all"):
        assert q[name](spark, sf).count() == t("search_results").filter("query is not null").select("search_id").distinct().count()
    assert q["block_reason_all"](spark, sf).count() == t("fetch_stats").select("stat_id").distinct().count()
    assert q["is_pdf_url_all"](spark, sf).count() == q["demoted_junk_all"](spark, sf).count() > 20


def test_streamed_pacing_is_the_batch_one(spark, tmp_path):
    rows = [("a", 1, 0), ("a", 2, 300), ("b", 3, 100), ("a", 4, 5000), ("b", 5, 900)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "engine string, id bigint, ms bigint").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("engine string, id bigint, ms bigint").parquet(src)
    q = stream_state.pacing(stream).writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = spark.createDataFrame(rows, "engine string, id bigint, ms bigint").withColumn("ts", F.timestamp_millis("ms"))
    want = {(r["engine"], r["id"], r["sleep_ms"]) for r in batch_state.pacing(batch, "engine", "ts", "id").collect()}
    assert {tuple(r) for r in spark.table("paced").collect()} == want


def simulated_crawl(links, pages, start, depth, most, chars):
    """The crawl of one seed, page by page."""
    queued, frontier, out, total, n = {start}, [start], [], 0, 0
    for level in range(depth + 1):
        found = []
        before = set(queued)
        for url in frontier:
            if n >= most or chars is not None and total >= chars:
                return out
            size = pages.get(url)
            out.append((url, level, size is not None))
            if size is None:
                continue
            n, total = n + 1, total + size
            if chars is None or total <= chars:
                best = sorted((x for x in links if x[0] == url and x[1] not in before), key=lambda x: (-x[2], x[3]))[:10]
                for _, dst, _, _ in best:
                    if dst not in queued:
                        queued.add(dst)
                        found.append(dst)
        frontier = found
    return out


def test_crawl_is_the_simulated_one(spark):
    import random

    rnd = random.Random(4)
    links = [(f"u{rnd.randrange(30)}", f"u{rnd.randrange(40)}", rnd.randrange(3), k) for k in range(260)]
    links = list({(a, b): (a, b, s, p) for a, b, s, p in links if a != b}.values())
    pages = {f"u{k}": rnd.randrange(10, 90) for k in range(34)}
    df = spark.createDataFrame(links, "src string, dst string, score int, pos int")
    pf = spark.createDataFrame(list(pages.items()), "url string, chars bigint")
    seeds = spark.createDataFrame([("a", "u0"), ("b", "u7"), ("c", "u39")], "seed string, url string")
    for most, chars in ((8, None), (100, 400), (100, None)):
        got = {}
        for r in sorted(crawl.crawl(df, pf, seeds, 2, most, chars).collect(), key=lambda r: (r["seed"], r["depth"], r["ord"])):
            got.setdefault(r["seed"], []).append((r["url"], r["depth"], r["ok"]))
        assert got == {s: simulated_crawl(links, pages, u, 2, most, chars) for s, u in (("a", "u0"), ("b", "u7"), ("c", "u39"))}


def test_crawl_of_nothing(spark):
    links = spark.createDataFrame([], "src string, dst string, score int, pos int")
    pages = spark.createDataFrame([], "url string, chars bigint")
    seeds = spark.createDataFrame([("a", "u0")], "seed string, url string")
    assert [tuple(r) for r in crawl.crawl(links, pages, seeds).select("url", "ok").collect()] == [("u0", False)]
    assert crawl.crawl(links, pages, seeds.limit(0)).count() == 0 and crawl.discover(links, seeds).count() == 1


def test_cache_keeps_and_finds(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "key string, at bigint, v string")
    new = spark.createDataFrame([("a", 9, "z"), ("c", 2, "w")], "key string, at bigint, v string")
    kept = batch_state.store(old, new, "key", "at", 2)
    assert sorted(map(tuple, kept.collect())) == [("a", 9, "z"), ("b", 5, "y")]
    cache = spark.createDataFrame([("a", 0), ("b", 3500)], "key string, s bigint").select("key", F.timestamp_seconds("s").alias("fetched"))
    req = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, key string")
    got = {r["id"]: r["_at"] is not None for r in batch_state.lookup(req, cache, "key", F.timestamp_seconds(F.lit(3700)), "fetched").collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}
    d = spark.range(1).select(batch_state.cooldown_ms(F.lit("ddg")).alias("a"), batch_state.cooldown_ms(F.lit("bing")).alias("b")).first()
    assert tuple(d) == (600_000, 120_000)


def test_infobox_comes_after_the_lead_and_html_is_sanitized():
    page = "<article><table class='infobox'><tr><td>Born</td><td>1900</td></tr></table><p>" + "A lead of the article with words. " * 8 + "</p><p>More.</p><div onclick='x()'>In <span>it</span></div><pre>a &lt; b</pre></article>"
    got = extract.extract(page, "https://a.example/")
    assert got["markdown"].index("A lead") < got["markdown"].index("Born | 1900") < got["markdown"].index("More.")
    assert "<pre><code>a &lt; b</code></pre>" in got["clean_html"] and "onclick" not in got["clean_html"] and "<span" not in got["clean_html"]
    assert extract.noisy("a Sign_Up") and extract.noisy("vector-sidebar") and not extract.noisy("navigator-free")


def test_literal_addresses_are_refused(spark):
    urls = ["http://[::1]/", "http://[2606:4700::1111]/", "http://127.0.0.1/", "http://8.8.8.8/", "ftp://a.example/", "https://a.example/", "http://localhost/", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(U.valid(F.col("u"))).collect()]
    assert [bool(x) for x in got] == [False, False, False, True, False, True, False, False]


def test_fetch_refuses_and_follows(spark):
    import http.server
    import threading

    import pytest

    from brookweave.sources import fetch

    class Site(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/go":
                self.send_response(302)
                self.send_header("Location", "/page?x=1")
                self.end_headers()
            elif self.path == "/in":
                self.send_response(302)
                self.send_header("Location", "http://10.0.0.1/")
                self.end_headers()
            else:
                body = ("<p>é</p>" if self.path.startswith("/page") else "x" * 50).encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/html" if self.path.startswith("/page") else "text/plain")
                self.end_headers()
                self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    local = lambda ip: ip == "127.0.0.1"
    got = fetch.request(base + "/go", local)
    assert (got.status, got.html, got.url) == (200, "<p>é</p>", base + "/page?x=1")
    assert len(fetch.request(base + "/page", local, 4).html.encode()) <= 7
    for url, public in ((base + "/page", lambda ip: False), (base + "/in", local), ("ftp://a.example/", local), ("http://[::1]/", local)):
        with pytest.raises(PermissionError):
            fetch.request(url, public)
    with pytest.raises(ValueError):
        fetch.request(base + "/plain", local, 10)
    server.shutdown()
    page = fetch.Fetched("https://a.example/", 200, "ok")
    wall = fetch.Fetched("https://a.example/", 403, "no")
    walled = lambda f: f.status == 403

    def fails(e):
        def run(url):
            raise e

        return run

    assert fetch.ladder("u", lambda u: page, walled) == (page, "http", False)
    assert fetch.ladder("u", lambda u: wall, walled) == (wall, "http", False)
    assert fetch.ladder("u", lambda u: wall, walled, lambda u: page) == (page, "chrome", True)
    assert fetch.ladder("u", fails(OSError("reset")), walled, lambda u: page)[1] == "chrome"
    for e in (TimeoutError(), PermissionError(fetch.REFUSED)):
        with pytest.raises(type(e)):
            fetch.ladder("u", fails(e), walled, lambda u: page)
    with pytest.raises(PermissionError):
        fetch.ladder("u", lambda u: wall, walled, lambda u: fetch.Fetched("http://10.1.1.1/", 200, "in"))
    rows = spark.createDataFrame([(1, "http://10.0.0.1/"), (0, "nope")], "ord bigint, url string")
    assert [r["error"].split(":")[0] for r in fetch.fetch_pages(rows, 2).collect()] == ["refused", "refused"]


def test_options_are_checked():
    import pytest

    from brookweave import api

    for bad in (lambda: api.ScrapeOptions(max_chars=0), lambda: api.SearchOptions(max_results=21), lambda: api.SearchOptions(fetch=9), lambda: api.SearchOptions(freshness="decade"), lambda: api.CrawlOptions(max_pages=51), lambda: api.CrawlOptions(max_total_chars=0), lambda: api.LinkOptions(most=0)):
        with pytest.raises(api.OptionError):
            bad()
    assert api.terms_of("How to (fix) C++ it's") == ["how", "fix", "it's"] and api.terms_of(None) == []


def test_scrape_of_odd_responses(spark):
    from brookweave import api

    rows = [("https://a.example/", None, False, "http"), ("https://b.example/", "", None, None), ("http://127.0.0.1/", "<p>x</p>", False, "http"), (None, "<p>x</p>", False, "http"), ("https://c.example/", "<p>" + "Words of a page. " * 40 + "</p>", False, "http")]
    got = {r["url"]: r for r in api.scrape(spark.createDataFrame(rows, "url string, response string, blocked boolean, tier string"), api.ScrapeOptions(max_chars=50)).collect()}
    assert len(got) == 5 and got["https://c.example/"]["content_ok"] and got["https://c.example/"]["next_offset"] == 50
    assert not got["http://127.0.0.1/"]["content_ok"] and got["http://127.0.0.1/"]["note"].startswith("blocked") and not got["https://a.example/"]["content_ok"]


def streamed(spark, tmp_path, rows, schema, make, name, mode="append"):
    src = str(tmp_path / f"in_{name}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    df = make(spark.readStream.schema(schema).parquet(src))
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return {tuple(r) for r in spark.table(name).collect()}


def test_streamed_cooldown_is_the_batch_one(spark, tmp_path):
    rows = [("ddg", 1, 0, True), ("ddg", 2, 599_999, False), ("ddg", 3, 600_000, False), ("bing", 4, 10, True), ("bing", 5, 119_000, True), ("bing", 6, 200_000, False), ("bing", 7, 240_000, False)]
    schema = "engine string, id bigint, ms bigint, blocked boolean"
    got = streamed(spark, tmp_path, rows, schema, stream_state.cooldown, "cooled")
    batch = batch_state.cooling(spark.createDataFrame(rows, schema), "engine", "ms", "blocked", "id", batch_state.cooldown_ms(F.col("engine")))
    assert got == {(r["engine"], r["id"], r["skip"]) for r in batch.collect()} and ("ddg", 2, True) in got and ("ddg", 3, False) in got


def test_streamed_windows_and_first_fetches(spark, tmp_path):
    import datetime as dt

    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    rows = [("a", at(1)), ("a", at(1, 20)), ("b", at(1, 30)), ("a", at(3))]
    schema = "url string, ts timestamp"
    counts = streamed(spark, tmp_path, rows, schema, lambda d: stream_state.windowed(d, "ts", "url"), "counted", "complete")
    assert {(k, n) for _, k, n in counts} == {("a", 2), ("b", 1), ("a", 1)}
    assert {r[0] for r in streamed(spark, tmp_path, rows, schema, lambda d: stream_state.first_fetches(d, "url", "ts"), "firsts")} == {"a", "b"}
