"""Page extraction: html to title, description, main content as markdown, links, media, code, type and quality.

One Arrow UDF parses a page once and returns a struct; `want_links` and `want_media` spare what a caller does not read.
The tree builder is iterative (void elements, implied ends of p, li, td and the like, raw text in script and style), so
depth is bounded by the document alone.  Null or empty html gives an empty document.
"""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.urls import join

#: Elements that hold no content, landmarks, and class words of page furniture.
SKIP = frozenset(
    "script style noscript template svg form input button select textarea nav footer aside iframe object embed canvas dialog link meta title base source track wbr col param area".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog".split())
NOISE = tuple(
    "nav navbar navigation menu sidebar breadcrumb breadcrumbs footer cookie consent banner signup sign-up login modal popup newsletter share sharing social related"
    " advert ad ads promo toc mw-jump-link mw-editsection reflist references navbox".split()
)
NOISE_RE = re.compile("-(?:" + "|".join(NOISE) + ")-")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("p div section article main header figure figcaption blockquote address details summary dl dt dd center fieldset".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ENDS_P = BLOCKS | frozenset("ul ol table pre h1 h2 h3 h4 h5 h6 hr li".split())
#: Where main content is looked for, in order.
TIERS = (
    lambda n: n.tag == "article",
    lambda n: n.tag == "main" or n.attrs.get("role") == "main",
    lambda n: n.attrs.get("id") == "mw-content-text" or "mw-parser-output" in _classes(n),
    lambda n: n.attrs.get("id") in ("content", "main") or bool({"content", "post", "entry-content"} & _classes(n)),
    lambda n: n.attrs.get("id") in ("mainbar", "question"),
)
CODE_CLASS = re.compile(r"(?:^|\s)(?:language|lang|highlight)-(?:source-)?([A-Za-z0-9+#._-]{1,30})")
SCHEMA = (
    "title string, description string, markdown string, clean_html string, text string, links array<struct<href:string,text:string>>, media array<string>,"
    " headings array<string>, page_type string, quality_score double"
)


def _classes(n: Node) -> set[str]:
    return set(n.attrs.get("class", "").split())


def noisy(names: str) -> bool:
    """Whether one of the class or id names holds a word of page furniture as a whole word."""
    return any(NOISE_RE.search(f"-{x.lower().replace('_', '-')}-") for x in names.split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "up")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            if isinstance(n, Node):
                todo.extend(reversed(n.kids))


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        shut = set(CLOSES.get(tag, ()))
        if tag in ENDS_P:
            shut.add("p")
        n = self.at
        while shut and n.up is not None and n.tag not in ("table", "ul", "ol", "div", "section", "article", "body"):
            if n.tag in shut:
                self.at = n.up
                break
            n = n.up
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.kids.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None and n.tag != tag:
            n = n.up
        if n.up is not None:
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(data)


def _size(node: Node) -> tuple[int, int]:
    """(bytes of text, bytes of it in links)."""
    text = linked = 0
    todo = [(node, False)]
    while todo:
        n, a = todo.pop()
        if isinstance(n, str):
            k = len(n.strip().encode())
            text += k
            linked += k * a
        elif n.tag not in ("script", "style", "noscript", "template"):
            todo.extend((k, a or n.tag == "a") for k in n.kids)
    return text, linked


def main_root(tree: Node) -> Node:
    """The candidate of the first tier with content whose text without links is longest; else the densest block; else all."""
    nodes = [n for n in tree.walk() if isinstance(n, Node)]
    for tier in TIERS:
        best, most = None, 0
        for n in [n for n in nodes if tier(n)][:10]:
            text, linked = _size(n)
            if text >= 200 and text - 2 * linked > most:
                best, most = n, text - 2 * linked
        if best is not None:
            return best
    best, most = None, 0
    for n in nodes:
        if n.tag in ("div", "section", "td"):
            own = sum(_size(k)[0] for k in n.kids if isinstance(k, Node) and k.tag in ("p", "pre", "blockquote", "ul", "ol"))
            if own >= 200 and own > most:
                best, most = n, own
    return best or next((n for n in nodes if n.tag == "body"), tree)


def _noise(n: Node, whole: int) -> bool:
    if n.tag in SKIP or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or n.attrs.get("role") in ROLES:
        return True
    if n.tag == "sup" and "reference" in n.attrs.get("class", ""):
        return True
    if n.tag == "header" and not any(isinstance(k, Node) and k.tag in ("h1", "h2") for k in n.walk()):
        return True
    if n.tag in ("pre", "code", "body", "html"):
        return False
    if noisy(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"):
        size = _size(n)[0]
        return size < 200 or size * 4 < whole
    return False


def _flat(n: Node) -> str:
    return "".join(k for k in n.walk() if isinstance(k, str))


class Writer:
    """Markdown of a subtree; also counts the text, link and paragraph bytes that page types are told by."""

    def __init__(self, base: str, whole: int):
        self.base, self.whole = base, whole
        self.out: list[str] = []
        self.box: list[str] | None = None
        self.text = self.link_text = self.p_text = self.links = 0

    def _line(self, n: Node) -> str:
        parts: list[str] = []
        todo: list = list(reversed(n.kids))
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                parts.append(k)
                self.text += len(k.strip().encode())
            elif k.tag == "br":
                parts.append("\n")
            elif k.tag == "img":
                src = join(k.attrs.get("src"), self.base)
                if src and k.attrs.get("alt"):
                    parts.append(f"![{k.attrs['alt']}]({src})")
                    self.text += len(k.attrs["alt"].encode())
            elif _noise(k, self.whole):
                continue
            elif k.tag == "a":
                label = " ".join(_flat(k).split())
                self.text += len(label.encode())
                href = join(k.attrs.get("href"), self.base)
                if label and href:
                    self.links += 1
                    self.link_text += len(label.encode())
                    parts.append(f"[{label}]({href})")
                else:
                    parts.append(label)
            elif k.tag in ("b", "strong", "i", "em", "code", "s", "del"):
                mark = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}.get(k.tag, "~~")
                inner = " ".join(_flat(k).split())
                self.text += len(inner.encode())
                parts.append(f"{mark}{inner}{mark}" if inner else "")
            else:
                todo.extend(reversed(k.kids))
        rows = (" ".join(x.split()) for x in "".join(parts).split("\n"))
        return "\n".join(x for x in rows if x)

    def _put(self, block: str) -> None:
        if block.strip():
            self.out.append(block)

    def _code(self, n: Node) -> None:
        body = _flat(n).replace("\r", "").strip("\n")
        self.text += len(body.strip().encode())
        found = None
        for x in (n, n.up, next((k for k in n.kids if isinstance(k, Node) and k.tag == "code"), None)):
            found = found or (CODE_CLASS.search(x.attrs.get("class", "")) if x is not None else None)
        fence = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", body)), default=0))
        self._put(f"{fence}{found[1] if found else ''}\n{body}\n{fence}")

    def write(self, root: Node) -> str:
        todo: list[tuple[str, object, str]] = [("n", root, "")]
        while todo:
            what, n, pad = todo.pop()
            if isinstance(n, str):
                if n.strip():
                    self.text += len(n.strip().encode())
                    self._put(" ".join(n.split()))
                continue
            if n is not root and _noise(n, self.whole):
                continue
            if re.fullmatch("h[1-6]", n.tag):
                line = self._line(n).replace("\n", " ")
                self._put(f"{'#' * int(n.tag[1])} {line}" if line else "")
            elif n.tag == "p":
                before = self.text
                self._put(self._line(n))
                self.p_text += self.text - before
                if self.box and self.text > before:
                    self._put("\n\n".join(self.box))
                    self.box = []
            elif n.tag == "pre":
                self._code(n)
            elif n.tag in ("ul", "ol"):
                rows, i = [], 0
                for k in n.kids:
                    if isinstance(k, Node) and k.tag == "li" and not _noise(k, self.whole):
                        i += 1
                        line = self._line(k).replace("\n", " ")
                        if line:
                            rows.append(f"{'-' if n.tag == 'ul' else f'{i}.'} {line}")
                self._put("\n".join(rows))
            elif n.tag == "table" and "infobox" in _classes(n):
                # the first infobox comes after the lead paragraph, up to INFOBOX bytes of it; others are dropped
                if self.box is None:
                    rows = [" | ".join(c for c in (self._line(c).replace("\n", " ") for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")) if c) for tr in n.walk() if isinstance(tr, Node) and tr.tag == "tr"]
                    self.box, size = [], 0
                    for row in rows:
                        size += len(row.encode())
                        if size > INFOBOX:
                            break
                        self.box.append(row)
            elif n.tag == "table":
                for tr in n.walk():
                    if isinstance(tr, Node) and tr.tag == "tr":
                        cells = [self._line(c).replace("\n", " ") for c in tr.kids if isinstance(c, Node) and c.tag in ("td", "th")]
                        self._put(" | ".join(c for c in cells if c))
            elif n.tag == "blockquote":
                self._put("\n".join("> " + x for x in self._line(n).split("\n") if x))
            elif n.tag == "hr":
                continue
            elif n.tag == "img":
                holder = Node("p", {}, None)
                holder.kids.append(n)
                self._put(self._line(holder))
            elif any(isinstance(k, Node) and (k.tag in ENDS_P or k.tag in BLOCKS or k.tag in ("body", "html")) for k in n.kids):
                todo.extend(("n", k, pad) for k in reversed(n.kids))
            else:
                self._put(self._line(n))
        if self.box:
            self._put("\n\n".join(self.box))
        return "\n\n".join(self.out)


#: Tags that the sanitized html keeps, and those that become paragraphs.
KEEP_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p ul ol li strong b em i code blockquote a".split())
BLOCK_TAGS = frozenset("div section article main header figure figcaption details summary dl dt dd address".split())
#: Bytes of an infobox that are shown.
INFOBOX = 1500


def clean_html(root: Node, base: str, whole: int) -> str:
    """The root with KEEP_TAGS alone: other tags give way to their content, blocks become paragraphs, code stays whole."""
    out: list[str] = []
    todo: list = [root]
    while todo:
        n = todo.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(_html.escape(n))
        elif n is not root and _noise(n, whole):
            continue
        elif n.tag == "pre":
            out.append("<pre><code>" + _html.escape(_flat(n).strip("\n")) + "</code></pre>")
        elif n.tag in ("br", "hr"):
            out.append(f"<{n.tag}>")
        elif n.tag == "img":
            src = join(n.attrs.get("src"), base)
            if src:
                out.append(f'<img src="{_html.escape(src)}" alt="{_html.escape(n.attrs.get("alt", ""))}">')
        else:
            tag = "p" if n.tag in BLOCK_TAGS and n is not root else n.tag if n.tag in KEEP_TAGS else ""
            if tag == "a":
                href = join(n.attrs.get("href"), base)
                out.append(f'<a href="{_html.escape(href)}">' if href else "<a>")
            elif tag:
                out.append(f"<{tag}>")
            if tag:
                todo.append((f"</{tag}>",))
            todo.extend(reversed(n.kids))
    return "".join(out)


def link_markdown(title: str, links: list[dict], text: str) -> str:
    """What stands for a page whose layout table came out as pipes: its text's start and its links, each once."""
    seen: dict[str, str] = {}
    for x in links:
        seen.setdefault(x["href"], x["text"])
    rows = [f"- [{t}]({h})" for h, t in list(seen.items())[:50]]
    parts = ([f"# {title}"] if title else []) + [" ".join(text.split())[:2000], "\n".join(rows)]
    return "\n\n".join(parts)


def is_artifact(md: str) -> bool:
    pipes, letters = md.count("|"), sum(c.isalpha() for c in md)
    return pipes > 20 and letters > 0 and pipes / letters > 0.05 and "|  " in md


def _links(tree: Node, base: str) -> list[dict]:
    out = []
    for n in tree.walk():
        if isinstance(n, Node) and n.tag == "a":
            href = join(n.attrs.get("href"), base)
            text = " ".join(_flat(n).split())[:100]
            if href and text:
                out.append({"href": href, "text": text})
                if len(out) == 100:
                    break
    return out[:50]


def _media(tree: Node, base: str) -> list[str]:
    seen: dict[str, None] = {}
    for n in tree.walk():
        if isinstance(n, Node) and n.tag == "img":
            src = join(n.attrs.get("src"), base)
            if src:
                seen.setdefault(src)
                if len(seen) == 50:
                    break
    return list(seen)


def extract(html: str | None, url: str | None, want_links: bool = True, want_media: bool = True) -> dict:
    if not html:
        return dict.fromkeys(("title", "description", "markdown", "text", "clean_html"), "") | {"links": [], "media": [], "headings": [], "page_type": "unknown", "quality_score": 0.0}
    parser = Tree()
    parser.feed(html)
    parser.close()
    tree, base = parser.root, url or ""
    nodes = [n for n in tree.walk() if isinstance(n, Node)]
    title = next((t for t in (" ".join(_flat(n).split()) for n in nodes if n.tag == "title") if t), "")
    meta = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "").strip() for n in reversed(nodes) if n.tag == "meta"}
    root = main_root(tree)
    w = Writer(base, _size(root)[0])
    whole_root = _size(root)[0]
    markdown = w.write(root)
    if is_artifact(markdown):
        markdown = link_markdown(title, _links(tree, base), _flat(root))
    text = " ".join(re.sub(r"[#*`>]|\]\([^)]*\)|!?\[", " ", markdown).split())
    links = _links(tree, base) if want_links else []
    if w.links >= 10 and 5 * w.link_text >= 2 * w.text and w.p_text < 200:
        kind = "list"
    elif "![" in markdown and w.text < 500:
        kind = "media"
    else:
        kind = "article" if w.text >= 100 else "unknown"
    size, whole = len(text.encode()), len(html.encode())
    score = 0.0 if not size else min(1.0, 0.4 * min(5 * size / whole, 1) + 0.3 * min(size / 5000, 1) + 0.15 * (len(title.encode()) > 5) + 0.15 * (0 < len(links) < 50))
    heads = [x.strip() for x in markdown.split("\n") if x.lstrip().startswith("#")][:20]
    return {
        "title": title, "description": meta.get("description") or meta.get("og:description") or "", "markdown": markdown, "text": text, "links": links,
        "media": _media(tree, base) if want_media else [], "clean_html": clean_html(root, base, whole_root), "headings": heads, "page_type": kind, "quality_score": score,
    }


def documents(pages: DataFrame, html: str, url: str, key: str, want_links: bool = True, want_media: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(key, keep, SCHEMA): the extracted documents, with the columns of pages that keep names."""

    @F.pandas_udf(SCHEMA)
    def run(source: pd.Series, at: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(h, u, want_links, want_media) for h, u in zip(source, at)])

    doc: Column = run(F.col(html), F.col(url))
    kept = [key, *(keep or [])]
    return pages.select(*kept, doc.alias("doc")).select(*kept, "doc.*")
