"""Helpers shared by the corpus operators: session, text and HTML handling."""

from __future__ import annotations

import html as _html
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_checkpoint(spark: SparkSession) -> None:
    """Use the cluster's folder of spark.checkpoint.dir.

    Where it is unset a local session (tests) gets one of its own; a cluster gets an error, since a machine-local folder
    is not shared by its executors.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), f"brookweave-{sc.applicationId}")
    sc.setCheckpointDir(where)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it from there, so that it is computed once."""
    shared_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def records(df: DataFrame) -> DataFrame:
    """scrape_results rows with text; deliveries of one scrape_id are equal and are removed by the callers' results."""
    return df.filter(F.col("scrape_id").isNotNull() & (F.length("markdown") > 0))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows by the key's hash, evenly spread: the same ones whenever it is read.

    Only the row count is gathered; the threshold is applied in the scan, so no text is moved to choose the sample.
    """
    n = df.count()
    if n <= rows:
        return df
    below = int(-(1 << 63) + (1 << 64) * (rows / n))
    return df.filter(F.xxhash64(key) < F.lit(below))


# ---------------------------------------------------------------- markdown lines

MARK = re.compile(r"^(?:\s*(?:[>*•\-+]|\d{1,3}[.)])\s+|\s*>+)+|^\s*#{1,6}\s+")
LINK = re.compile(r"!?\[([^\]]*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)\)")
NONWORD = re.compile(r"[\W_]+")


def plain(line: str) -> str:
    """Letters and digits of a line in lower case: what is left when markup, spacing and marks are gone."""
    return NONWORD.sub("", LINK.sub(r"\1", line)).lower()


# ---------------------------------------------------------------- html blocks

#: HTML names that are fixed by the standard.
BLOCK = frozenset("p li h1 h2 h3 h4 h5 h6 tr pre blockquote dt dd figcaption caption address".split())
WRAP = frozenset("div nav article footer aside section header main ul ol table tbody thead body form figure dl".split())
TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s[^<>]*)?)/?>", re.S)
CLASS = re.compile(r"""class\s*=\s*["']?([^"'\s>]+)""")


def blocks(source: str) -> list[tuple[str, str]]:
    """The (root-to-leaf tag path, text) of every text block, in document order.

    A path names wrappers with their first class.  A block outside all wrappers has the path ``~/tag`` on a page
    that has wrappers elsewhere and ``=/tag`` on a page that has none, since there paths tell nothing apart.
    """
    found: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    where, leaf, text, at = "", "", [], 0

    def close() -> None:
        nonlocal leaf, text
        body = _html.unescape("".join(text)).strip()
        if body:
            found.append((f"{where}/{leaf or '#'}", body))
        leaf, text = "", []

    for m in TAG.finditer(source):
        if m.start() > at:
            text.append(source[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            close()
            if not m[2]:
                leaf = name
        elif name in WRAP:
            close()
            if not m[2]:
                c = CLASS.search(m[4] or "")
                stack.append((name, f"{name}.{c[1]}" if c else name))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            where = "/".join(p for _, p in stack)
        elif name in ("td", "th", "br"):
            text.append(" ")
    text.append(source[at:])
    close()
    bare = "~" if any(p[0] != "/" for p, _ in found) else "="
    return [(bare + p if p[0] == "/" else p, t) for p, t in found]


def aligned(markdown: str, source: str | None) -> list[tuple[int, str, str]]:
    """(line_no, line, path) of every non-blank line; the path is '' where no HTML block has the line's text."""
    lines = [(i, x) for i, x in enumerate(markdown.split("\n"), 1) if x.strip()]
    if not source:
        return [(i, x, "") for i, x in lines]
    parts = blocks(source)
    out: list[tuple[int, str, str]] = []
    keys = [plain(t) for _, t in parts]
    if [plain(x) for _, x in lines] == keys:
        return [(i, x, p) for (i, x), (p, _) in zip(lines, parts)]
    place: dict[str, list[int]] = {}
    for k in range(len(keys) - 1, -1, -1):
        place.setdefault(keys[k], []).append(k)
    last = -1
    for i, x in lines:
        spots = place.get(plain(x), [])
        while spots and spots[-1] <= last:
            spots.pop()
        if spots:
            last = spots.pop()
            out.append((i, x, parts[last][0]))
        else:
            out.append((i, x, ""))
    return out
