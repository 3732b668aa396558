"""Result pages of search engines: parse_serp(engine, html) as an Arrow UDF over a recorded table of pages.

Each engine has a rule of its own: the element of a result, and in it the anchor, the title and the snippet.  A result needs a title, an http
address after unwrapping redirects, and a host that is no engine's own.  Rows and snippets of the plain table layout
are paired by order: a snippet belongs to the link before it.
"""

from __future__ import annotations

import base64
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.urls import ENGINE_HOSTS
from .extract import Node, Tree

#: Per engine the base address and how a result, its anchor, title and snippet are told.
RULES = {
    "ddg": ("https://duckduckgo.com/", {"class": "result"}, {"tag": "a", "in": {"tag": "h2", "class": "result__title"}}, None, [{"class": "result__snippet"}]),
    "bing": (
        "", {"tag": "li", "class": "b_algo"}, {"tag": "a", "in": {"tag": "h2"}}, None,
        [{"tag": "p", "in": {"class": "b_caption"}}, {"class": "b_lineclamp2"}, {"class": "b_lineclamp3"}, {"class": "b_lineclamp4"}],
    ),
    "brave": ("", {"tag": "div", "data-type": "web"}, {"tag": "a", "href": None}, {"class": "search-snippet-title"}, [{"class": "snippet-description"}, {"class": "generic-snippet"}]),
    "mojeek": ("", {"tag": "li", "in": {"tag": "ul", "class": "results-standard"}}, {"tag": "a", "class": "title"}, None, [{"tag": "p", "class": "s"}]),
    "yahoo": ("", {"tag": "div", "class": "algo"}, {"tag": "a", "href": None, "in": {"tag": "div", "class": "compTitle"}}, {"tag": "h3", "class": "title"}, [{"tag": "div", "class": "compText"}]),
}
#: The link and snippet of the plain table layout.
LITE_LINK, LITE_SNIPPET = "result-link", "result-snippet"
SCHEMA = ArrayType(StructType([StructField(n, StringType()) for n in ("title", "url", "snippet")]))


def unwrap(url: str) -> str:
    s = urlsplit(url)
    q = parse_qs(s.query)
    if "uddg" in q:
        return q["uddg"][0]
    if "/ck/a" in s.path and "u" in q:
        raw = q["u"][0].removeprefix("a1")
        try:
            got = base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)).decode("utf-8", "replace")
        except ValueError:
            return url
        return got if got.startswith("http") else url
    if "/RU=" in url:
        got = unquote(url.split("/RU=", 1)[1].split("/", 1)[0])
        return got if got.startswith("http") else url
    return url


def admitted(title: str, url: str) -> bool:
    host = (urlsplit(url).hostname or "").lower()
    return bool(title) and url.startswith("http") and bool(host) and "duckduckgo.com/y.js" not in url and not host.endswith(ENGINE_HOSTS)


def _is(n: Node, want: dict, top: Node | None = None) -> bool:
    for key, value in want.items():
        if key == "tag":
            ok = n.tag == value
        elif key == "class":
            ok = value in n.attrs.get("class", "").split()
        elif key == "in":
            ok, up = False, n.up
            while up is not None and not ok:
                ok, up = _is(up, value), up.up
        else:
            ok = key in n.attrs and (value is None or n.attrs[key] == value)
        if not ok:
            return False
    return True


def _first(n: Node, wants: list[dict]) -> Node | None:
    return next((k for k in n.walk() if isinstance(k, Node) and k is not n and any(_is(k, w) for w in wants)), None)


def _label(n: Node | None) -> str:
    """Text nodes joined by blanks."""
    return "" if n is None else " ".join(" ".join(k for k in n.walk() if isinstance(k, str)).split())


def _lite(tree: Node) -> list[tuple[str, str, str]]:
    """A snippet row belongs to the link row before it, if that link was admitted."""
    out: list[list[str]] = []
    open_hit = False
    for tr in tree.walk():
        if not isinstance(tr, Node) or tr.tag != "tr":
            continue
        a, note = _first(tr, [{"tag": "a", "class": LITE_LINK}]), _first(tr, [{"class": LITE_SNIPPET}])
        if a is not None:
            url = unwrap(urljoin("https://duckduckgo.com/", a.attrs.get("href", "").strip()))
            open_hit = admitted(_label(a), url)
            if open_hit:
                out.append([_label(a), url, ""])
        elif note is not None and open_hit:
            out[-1][2] = _label(note)
            open_hit = False
    return [tuple(x) for x in out]


def parse(engine: str | None, html: str | None) -> list[dict]:
    """The admitted results of a page in their order; an unknown engine and null or empty html give none."""
    if not html or engine not in (*RULES, "ddg-lite"):
        return []
    tree = Tree()
    tree.feed(html)
    tree.close()
    if engine == "ddg-lite":
        found = _lite(tree.root)
    else:
        base, result, link, named, notes = RULES[engine]
        found = []
        for n in tree.root.walk():
            if isinstance(n, Node) and _is(n, result):
                a = _first(n, [link])
                if a is not None:
                    url = unwrap(urljoin(base, a.attrs.get("href", "").strip()))
                    found.append((_label((_first(n, [named]) if named else None) or a), url, _label(_first(n, notes))))
        found = [x for x in found if admitted(x[0], x[1])]
        if engine == "ddg" and not found:
            # any anchor with a title of fair length
            anchors = ((_label(n), unwrap(urljoin(base, n.attrs["href"].strip()))) for n in tree.root.walk() if isinstance(n, Node) and n.tag == "a" and n.attrs.get("href"))
            found = [(t, u, "") for t, u in anchors if 10 <= len(t.encode()) <= 200 and admitted(t, u)]
    return [dict(zip(("title", "url", "snippet"), x)) for x in found]


@F.pandas_udf(SCHEMA)
def parse_serp(engine: pd.Series, html: pd.Series) -> pd.Series:
    return pd.Series([parse(e, h) for e, h in zip(engine, html)])
