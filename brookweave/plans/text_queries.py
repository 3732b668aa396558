"""Focus, paging, terms and markdown queries over documents and scrape_results, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import focus as X
from ..operators import render as R

#: The parameters of the focus queries: terms and paragraphs kept.
TERMS, KEEP = ("valve", "sensor", "housing"), 3


def _docs(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.regexp_replace("text", "\r\n|\r", "\n").alias("text")).filter(F.length("text") > 0)


def _values(s: SparkSession, rows: str, cols: str) -> DataFrame:
    return s.sql(f"SELECT * FROM VALUES {rows} AS t({cols})")


def _paras():
    return F.split("text", "\n", -1)


def _weighted(s, d):
    return _docs(s, d).select("doc_id", X.weights(_paras(), list(TERMS)).alias("w")).select("doc_id", "w.*")


def _scored(s, d):
    return _docs(s, d).select("doc_id", F.explode(X.scored(_paras(), list(TERMS))).alias("x")).select("doc_id", "x.i", "x.score")


def _top(s, d):
    q = _docs(s, d).select("doc_id", F.posexplode(X.best(X.scored(_paras(), list(TERMS)), KEEP)).alias("k", "x"))
    return q.select("doc_id", "x.i", "x.score", (F.col("k") + 1).alias("rnk"))


def _view(s, d):
    docs = _docs(s, d)
    return X.view(docs.withColumn("np", F.size(_paras())), "text", _paras(), list(TERMS), KEEP)


_SQL_DOCS = r"docs AS (SELECT doc_id, regexp_replace(text, '\r\n|\r', chr(10), 'g') AS text FROM documents WHERE length(text) > 0)"
_SQL_PARAS = (
    _SQL_DOCS
    + """, paras AS (SELECT doc_id, i::BIGINT AS i, lst[i + 1] AS p FROM
 (SELECT doc_id, string_split(text, chr(10)) AS lst FROM docs), LATERAL (SELECT unnest(range(len(lst))) AS i))"""
)


def _tf(t: str) -> str:
    return f"((length(lower(p)) - length(replace(lower(p), '{t}', ''))) / {len(t)})::BIGINT"


_SQL_TF = _SQL_PARAS + ", tf AS (SELECT doc_id, i, p, count(*) OVER (PARTITION BY doc_id) AS n, " + ", ".join(
    f"{_tf(t)} AS tf_{k}, count(*) FILTER ({_tf(t)} > 0) OVER (PARTITION BY doc_id) AS df_{k}" for k, t in enumerate(TERMS)
) + " FROM paras)"
_SQL_SCORE = (
    _SQL_TF
    + ", scored AS (SELECT doc_id, i, p, n, round(("
    + " + ".join(f"tf_{k} * greatest(0.1::DOUBLE, ln((n::DOUBLE - df_{k} + 0.5::DOUBLE) / (df_{k} + 0.5::DOUBLE) + 1))" for k in range(len(TERMS)))
    + ") * (CASE WHEN ltrim(p, ' ') LIKE '#%' THEN 2.0 WHEN ltrim(p, ' ') LIKE '**%' THEN 1.5 ELSE 1.0 END)::DOUBLE * (CASE WHEN i < 3 THEN 1.1 ELSE 1.0 END)::DOUBLE, 9) AS score FROM tf)"
)
_SQL_TOP = _SQL_SCORE + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rnk
 FROM scored WHERE score > 0) WHERE rnk <= {KEEP})"""
_SQL_RENDER = _SQL_TOP + ", r AS (SELECT doc_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS focused, count(*) AS kept FROM top GROUP BY doc_id)"

_DOUBLED = "replace(text, chr(10), chr(10) || chr(10))"


def _doubled(s, d):
    return _docs(s, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def _cut_sql(limit: int) -> str:
    head = f"substring(t, 1, {limit})"
    return f"""cut AS (SELECT doc_id, t, CASE WHEN length(t) <= {limit} THEN t
 WHEN strpos(reverse({head}), chr(10) || chr(10)) > 0 AND strlen(substring(t, 1, {limit} - strpos(reverse({head}), chr(10) || chr(10)) - 1)) * 2 > strlen({head})
 THEN substring(t, 1, {limit} - strpos(reverse({head}), chr(10) || chr(10)) - 1) ELSE {head} END AS piece FROM d2)"""


def _page_cut(s, d, limit=600):
    q = _doubled(s, d).withColumn("piece", T.truncate(F.col("text"), limit))
    nxt = F.when(F.length("piece") < F.length("text"), F.length("piece").cast("bigint"))
    return q.select("doc_id", "piece", nxt.alias("next_offset"))


def _page_walk_all(s, d, limit=600):
    """Every page of a text to its end; next_offset is null on the last one."""
    q = _doubled(s, d).select("doc_id", F.length("text").alias("n"), F.posexplode(T.walk(F.col("text"), limit)).alias("page_no", "p"))
    end = F.col("p.offset") + F.col("p.length")
    return q.select("doc_id", "page_no", "p.offset", "p.length", F.when(end < F.col("n"), end).alias("next_offset"))


def _page_size(t: str, limit: int) -> str:
    """The length of the page that truncate cuts of a SQL text."""
    head = f"substring({t}, 1, {limit})"
    back = f"strpos(reverse({head}), chr(10) || chr(10))"
    return f"""(CASE WHEN length({t}) <= {limit} THEN length({t}) WHEN {back} > 0 AND strlen(substring({t}, 1, {limit} - {back} - 1)) * 2 > strlen({head}) THEN {limit} - {back} - 1 ELSE {limit} END)"""


FENCES = (
    "(1, 'a\\n```py\\nx'), (2, '```\\nx\\n```\\nend'), (3, '~~~~\\n```\\n~~~\\n~~~~\\nz'), (4, 'plain'), (5, '````\\n```\\nq'), (6, ''), (7, '```a\\nb\\n``` c\\n')"
)
_FENCE_SQL = "(1, '`', 3), (2, '', 0), (3, '', 0), (4, '', 0), (5, '`', 4), (6, '', 0), (7, '`', 3)"


def _fence_closed(s, d):
    return _values(s, FENCES, "id, md").select("id", T.close_fence(F.col("md")).alias("closed"))


def _fence_state(s, d):
    st = T.fence_state(F.col("md"))
    return _values(s, FENCES, "id, md").select("id", st["ch"].alias("ch"), st["len"].alias("len"))


PARAS = "(1, 'a\\n\\nb'), (2, 'x\\n\\n```\\none\\n\\ntwo\\n```\\n\\ny'), (3, ''), (4, '```\\nq\\n\\nr')"


def _paragraphs(s, d):
    return _values(s, PARAS, "id, md").select("id", F.posexplode(T.paragraphs(F.col("md"))).alias("i", "p"))


QUERIES_V = "(1, 'How to fix the  Rust (borrow) checker'), (2, 'what is 42 vs 43'), (3, 'C++ a bc BC x'), (4, '')"


def _focus_terms(s, d):
    return _values(s, QUERIES_V, "id, q").select("id", F.array_join(T.focus_terms(F.col("q")), "|").alias("terms"))


def _query_terms(s, d):
    return _values(s, QUERIES_V, "id, q").select("id", F.array_join(T.query_terms(F.col("q")), "|").alias("terms"))


def _table_artifact(s, d):
    rows = "(1, 'a |  b | c | d | e | f | g | h | i | j | k | l | m | n | o | p | q | r | s | t | u | v | w'), (2, 'a | b'), (3, 'text without pipes')"
    return _values(s, rows, "id, md").select("id", T.table_artifact(F.col("md")).alias("artifact"))


def _sections(s, d):
    """Markdown sections of pages, with the command that continues a cut one."""
    p = s.read.parquet(f"{d}/scrape_results.parquet").filter("markdown <> ''")
    return p.select("scrape_id", R.page_section(R.Page.of(), SECTION_FOCUS, SECTION_CHARS).alias("section")).distinct()


def _batch_sections(s, d):
    """Sections of a batch, a failed page among them; pages without text count as failed ones."""
    p = s.read.parquet(f"{d}/scrape_results.parquet").filter("url is not null")
    error = F.when(F.coalesce("markdown", F.lit("")) == "", F.coalesce("note", F.lit("no answer")))
    return p.select("scrape_id", R.batch_section(R.Page.of(), error, SECTION_FOCUS, SECTION_CHARS).alias("section")).distinct()


SECTION_FOCUS, SECTION_CHARS = "it's new", 25_000
_HINT_SQL = (
    "CASE WHEN next_offset IS NULL THEN ZZ ELSE chr(10) || chr(10) || Z<!-- truncated at Z || next_offset::VARCHAR || CASE WHEN focused_chars > 0 THEN Z of Z || focused_chars::VARCHAR ELSE ZZ END"
    " || Z chars; more: brookweave scrape Z || chr(39) || replace(url, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) || Z --offset Z || next_offset::VARCHAR"
    f" || Z --max-chars {SECTION_CHARS} --focus Z || chr(39) || ZitZ || chr(39) || chr(92) || chr(39) || chr(39) || Zs newZ || chr(39) || Z -->Z END"
).replace("Z", "'")
_META_SQL = "'<!-- tier: ' || coalesce(tier, '') || ' content_ok: ' || coalesce(content_ok, false)::VARCHAR || ' chars: ' || coalesce(total_chars, 0)::VARCHAR || ' -->' || chr(10) || chr(10)"
_SECTION_SQL = f"SELECT DISTINCT scrape_id, '# ' || coalesce(title, '') || chr(10) || {_META_SQL} || markdown || coalesce({_HINT_SQL}, '') AS section FROM scrape_results WHERE markdown <> ''"
_BATCH_SQL = f"""SELECT DISTINCT scrape_id, '## ' || url || chr(10) || CASE WHEN coalesce(markdown, '') = '' THEN '<!-- error: ' || coalesce(note, 'no answer') || ' -->' || chr(10) || chr(10) || '_fetch failed_' || chr(10)
 ELSE {_META_SQL} || markdown || {_HINT_SQL} || chr(10) END AS section FROM scrape_results WHERE url IS NOT NULL"""


def _stats(s, d):
    p = s.read.parquet(f"{d}/scrape_results.parquet")
    n = F.coalesce(F.length("markdown"), F.lit(0)).cast("bigint")
    return p.groupBy("tier").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if("content_ok").alias("ok"), F.sum(n).alias("chars_out"), F.sum(F.expr("coalesce(length(markdown), 0) div 4")).alias("est_tokens"),
        (F.count_if(~F.col("content_ok")) == F.count(F.lit(1))).alias("all_failed"),
    )


def _headings(s, d):
    p = s.read.parquet(f"{d}/scrape_results.parquet").filter("markdown <> ''")
    h = T.headings(F.col("markdown"))
    return p.select("scrape_id", F.size(h).alias("n"), F.array_join(h, "\n").alias("headings")).distinct()


def _escape(s, d):
    rows = "(1, 'a<b & \"c\">d'), (2, 'it''s'), (3, '')"
    return _values(s, rows, "id, t").select("id", T.escape_html(F.col("t")).alias("html"), T.shell_quote(F.col("t")).alias("shell"))


def _collapse(s, d):
    p = s.read.parquet(f"{d}/search_hits.parquet").filter("snippet is not null")
    return p.select("hit_id", T.collapse(F.col("snippet")).alias("text")).distinct()


QUERIES = {
    "focus_render": lambda s, d: _view(s, d).filter("not missed").select("doc_id", "focused", "kept"),
    "focus_terms_df": lambda s, d: _weighted(s, d).select("doc_id", "n", "df_0", "df_1", "df_2"),
    "focus_scores": _scored,
    "focus_topk": _top,
    "focus_miss": lambda s, d: _view(s, d).select("doc_id", F.length("focused").cast("bigint").alias("chars"), "missed"),
    "focus_dropped_paras": lambda s, d: _view(s, d).select("doc_id", F.when(F.col("missed"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("np") - F.col("kept"))).cast("bigint").alias("dropped")),
    "page_slice": lambda s, d: _docs(s, d).select("doc_id", T.take_chars(F.col("text"), 100).alias("head"), T.slice_at(F.col("text"), F.lit(100)).alias("rest")),
    "page_cut": _page_cut,
    "page_walk_all": _page_walk_all,
    "fence_close": _fence_closed,
    "fence_state": _fence_state,
    "paragraphs": _paragraphs,
    "focus_query_words": _focus_terms,
    "query_terms": _query_terms,
    "table_artifact": _table_artifact,
    "md_sections": _sections,
    "batch_sections": _batch_sections,
    "batch_stats": _stats,
    "page_headings": _headings,
    "escaping": _escape,
    "ws_collapse": _collapse,
}

SQL = {
    "focus_render": f"WITH {_SQL_RENDER} SELECT doc_id, focused, kept FROM r",
    "focus_terms_df": f"WITH {_SQL_TF} SELECT DISTINCT doc_id, n, df_0, df_1, df_2 FROM tf",
    "focus_scores": f"WITH {_SQL_SCORE} SELECT doc_id, i::INT AS i, score FROM scored WHERE score > 0",
    "focus_topk": f"WITH {_SQL_TOP} SELECT doc_id, i::INT AS i, score, rnk::INT AS rnk FROM top",
    "focus_miss": f"WITH {_SQL_RENDER} SELECT doc_id, length(coalesce(focused, text))::BIGINT AS chars, focused IS NULL AS missed FROM docs LEFT JOIN r USING (doc_id)",
    "focus_dropped_paras": f"WITH {_SQL_RENDER} SELECT doc_id, CASE WHEN focused IS NULL THEN 0 ELSE greatest(0, len(string_split(text, chr(10))) - kept) END::BIGINT AS dropped FROM docs LEFT JOIN r USING (doc_id)",
    "page_slice": f"WITH {_SQL_DOCS} SELECT doc_id, substring(text, 1, 100) AS head, substring(text, 101) AS rest FROM docs",
    "page_cut": f"WITH {_SQL_DOCS}, d2 AS (SELECT doc_id, {_DOUBLED} AS t FROM docs), {_cut_sql(600)} SELECT doc_id, piece, CASE WHEN length(piece) < length(t) THEN length(piece)::BIGINT END AS next_offset FROM cut",
    "page_walk_all": f"""WITH RECURSIVE {_SQL_DOCS}, w AS (SELECT doc_id, 0 AS page_no, 0::BIGINT AS at, {_DOUBLED} AS rest, {_page_size(_DOUBLED, 600)}::BIGINT AS n FROM docs
 UNION ALL SELECT doc_id, page_no + 1, at + n, substring(rest, n + 1), {_page_size('substring(rest, n + 1)', 600)}::BIGINT FROM w WHERE n < length(rest))
 SELECT doc_id, page_no::INT AS page_no, w.at AS "offset", n AS length, CASE WHEN n < length(rest) THEN w.at + n END AS next_offset FROM w""".replace(" at,", " pos,").replace(" at + n", " pos + n").replace("AS at", "AS pos").replace("w.at", "w.pos"),
    "fence_state": f"SELECT * FROM (VALUES {_FENCE_SQL}) t(id, ch, len)",
    "fence_close": """SELECT * FROM (VALUES (1, 'a' || chr(10) || '```py' || chr(10) || 'x' || chr(10) || '```'), (2, '```' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'end'),
 (3, '~~~~' || chr(10) || '```' || chr(10) || '~~~' || chr(10) || '~~~~' || chr(10) || 'z'), (4, 'plain'), (5, '````' || chr(10) || '```' || chr(10) || 'q' || chr(10) || '````'), (6, ''),
 (7, '```a' || chr(10) || 'b' || chr(10) || '``` c' || chr(10) || '```')) t(id, closed)""",
    "paragraphs": """SELECT * FROM (VALUES (1, 0, 'a'), (1, 1, 'b'), (2, 0, 'x'), (2, 1, '```' || chr(10) || 'one' || chr(10) || chr(10) || 'two' || chr(10) || '```'), (2, 2, 'y'), (3, 0, ''),
 (4, 0, '```' || chr(10) || 'q' || chr(10) || chr(10) || 'r')) t(id, i, p)""",
    "focus_query_words": "SELECT * FROM (VALUES (1, 'how|fix|the|rust|borrow|checker'), (2, 'what'), (3, ''), (4, '')) t(id, terms)",
    "query_terms": "SELECT * FROM (VALUES (1, 'fix|rust|borrow|checker'), (2, ''), (3, 'bc'), (4, '')) t(id, terms)",
    "table_artifact": "SELECT * FROM (VALUES (1, true), (2, false), (3, false)) t(id, artifact)",
    "md_sections": _SECTION_SQL,
    "batch_sections": _BATCH_SQL,
    "batch_stats": """SELECT tier, count(*) AS pages, count(*) FILTER (content_ok) AS ok, sum(coalesce(length(markdown), 0))::BIGINT AS chars_out,
 sum(coalesce(length(markdown), 0) // 4)::BIGINT AS est_tokens, count(*) FILTER (NOT content_ok) = count(*) AS all_failed FROM scrape_results GROUP BY tier""",
    "page_headings": """WITH h AS (SELECT DISTINCT scrape_id, list_filter(string_split(markdown, chr(10)), lambda x: ltrim(x, ' ') LIKE '#%')[1:20] AS l FROM scrape_results WHERE markdown <> '')
 SELECT scrape_id, len(l)::INT AS n, array_to_string(l, chr(10)) AS headings FROM h""",
    "escaping": """SELECT * FROM (VALUES (1, 'a&lt;b &amp; &quot;c&quot;&gt;d', '''a<b & "c">d'''), (2, 'it''s', '''it''\\''''s'''), (3, '', '''''')) t(id, html, shell)""",
    "ws_collapse": r"SELECT DISTINCT hit_id, trim(regexp_replace(snippet, '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'), ' ') AS text FROM search_hits WHERE snippet IS NOT NULL",
}
