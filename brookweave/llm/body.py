"""Problem 7: the main body of a page, by tag-path ratios.

Text length and punctuation are summed per site and root-to-leaf tag path of ``clean_html`` (map-side combined, so a
site with a third of all rows costs no more per row than another).  The ratios per node are smoothed with those of the
path's wrapper, fused into one score and thresholded per site; the paths above it are content paths and the blocks
under them content nodes.  Pages whose HTML has no wrappers, or no HTML, have no telling paths: there a line model
decides that was fitted on a bounded sample of lines which the path ratios have labelled.

Null or empty ``markdown``: no rows.  Null ``clean_html``: the line model.  Repeated deliveries of a ``scrape_id``
give one set of rows.  A null ``site`` is a site of its own.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LINK, aligned, blocks, bounded_sample, cut, records

#: Share of the smoothed score that comes from the wrapper, and the part of a site's best score a content path reaches.
SMOOTH, THRESHOLD = 0.6, 0.35
#: The line model: pages in its sample and bytes of each (bounds), buckets of hashed features, passes.
BROADCAST_BYTES = 16 << 20
SAMPLE_PAGES, SAMPLE_BYTES, BUCKETS, PASSES = 2000, 65_536, 1 << 17, 3

END = re.compile(r"[.!?。！？…:;,、，]")
WORD = re.compile(r"[^\W\d_]+|\d+")
STOP = re.compile(r"[.!?。！？…][\"'”’»)*_]*\s*$")


# ---------------------------------------------------------------- path ratios


def _path_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[tuple, list[int]] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=["site", "path", "nodes", "chars", "marks"])

    for batch in batches:
        for site, source in zip(batch["site"], batch["clean_html"]):
            for path, text in blocks(source):
                s = sums.setdefault((site, path), [0, 0, 0])
                s[0] += 1
                s[1] += len(text)
                s[2] += len(END.findall(text))
        if len(sums) > 50_000:
            yield rows()
            sums.clear()
    if sums:
        yield rows()


def path_ratios(pages: DataFrame) -> DataFrame:
    """(site, path, score, content): the smoothed, fused ratio of each path against its site's best."""
    sums = (
        pages.filter(F.length("clean_html") > 0)
        .select("site", "clean_html")
        .mapInPandas(_path_sums, "site string, path string, nodes bigint, chars bigint, marks bigint")
        .filter(~F.col("path").startswith("=/"))
        .groupBy("site", "path")
        .agg(F.sum("nodes").alias("nodes"), F.sum("chars").alias("chars"), F.sum("marks").alias("marks"))
        .withColumn("wrapper", F.regexp_replace("path", "/[^/]*$", ""))
    )
    from pyspark.sql import Window

    wrap = Window.partitionBy("site", "wrapper")
    site = Window.partitionBy("site")
    ratio = lambda chars, marks, nodes: F.sqrt(chars / nodes * (1 + marks / nodes))
    s = sums.withColumn("leaf", ratio(F.col("chars"), F.col("marks"), F.col("nodes")))
    s = s.withColumn("whole", ratio(F.sum("chars").over(wrap), F.sum("marks").over(wrap), F.sum("nodes").over(wrap)))
    # length alone misleads on sites of few pages: the wrapper's share of the site's text counts too
    s = s.withColumn("share", F.sum("chars").over(wrap) / F.sum("chars").over(site))
    s = s.withColumn("fused", F.col("whole") * F.sqrt("share"))
    s = s.withColumn(
        "score",
        SMOOTH * F.col("fused") / F.max("fused").over(site)
        + (1 - SMOOTH) * F.least(F.lit(1.0), F.col("leaf") / F.max("whole").over(site)) * F.col("fused") / F.max("fused").over(site),
    )
    bare = F.col("wrapper").isin("~")
    return s.select("site", "path", "score", (~bare & (F.col("score") >= THRESHOLD)).alias("content"))


def content_paths(pages: DataFrame) -> DataFrame:
    """(site, content_paths): the content paths of each site, one row per site."""
    return (
        path_ratios(pages)
        .filter("content")
        .groupBy("site")
        .agg(F.sort_array(F.collect_set("path")).alias("content_paths"))
    )


# ---------------------------------------------------------------- line model


def features(lines: list[tuple[int, str]]) -> list[np.ndarray]:
    """Hashed features of each (line_no, line) of a page: its words, marks and links, its place and its neighbours."""
    n = len(lines)
    low = [x.lower() for _, x in lines]
    words = [["0" if w[0].isdigit() else w for w in WORD.findall(LINK.sub(r"\1", x))] for x in low]
    heads = [i for i, (_, x) in enumerate(lines) if x.lstrip(" >*").startswith("# ")]
    first = heads[0] if heads else -1
    prose = [i for i in range(n) if len(lines[i][1]) > 160 and STOP.search(lines[i][1])]
    last = prose[-1] if prose else -1
    head = [" ".join(w[:2]) for w in words]
    out = []
    for i, (no, x) in enumerate(lines):
        w = words[i]
        links = LINK.findall(x)
        near = sum(1 for _, h in links if not h.startswith("http"))
        lead = re.match(r"\s*([#>*•|`-]+|\d+[.)])?", x)[0].strip()[:4]
        kind = (
            f"{lead and lead[0]}{len(links) > 0:d}{near > 0:d}{bool(STOP.search(x)):d}"
            f"{sum(len(t) for t, _ in links) * 3 > len(LINK.sub(r'\1', x)) * 2:d}"
        )
        f = {f"w{a}" for a in w}
        f.update(f"b{a} {b}" for a, b in zip(w, w[1:]))
        f.add(f"f{head[i]}")
        f.add(f"k{kind}")
        f.add(f"k{kind}{int(math.log2(len(w) + 1))}")
        f.add(f"l{int(math.log2(len(x) + 1))}")
        f.add(f"c{int(math.log2(len(w) + 1))}")
        f.add(f"t{min(i, 8)}")
        f.add(f"u{min(n - 1 - i, 8)}")
        f.add("h0" if first < 0 else "h-" if i < first else "h=" if i == first else f"h+{min(i - first, 2)}")
        f.add("p0" if last < 0 else "p-" if i <= last else f"p+{min(i - last, 3)}")
        f.add(f"e{'|' in x:d}{'·' in x:d}{'©' in x:d}{'@' in x:d}{x.count(' > ') > 0:d}{x.count(' / ') > 1:d}")
        for tag, j in (("<", i - 1), (">", i + 1)):
            if 0 <= j < n:
                gap = abs(lines[j][0] - no) > 1
                f.add(f"{tag}{gap:d}{head[j]}")
                f.add(f"{tag}{gap:d}l{int(math.log2(len(low[j]) + 1))}{kind}")
                f.add(f"{tag}{gap:d}f{head[j]}|{kind}")
        out.append(np.fromiter((zlib.crc32(v.encode()) % BUCKETS for v in f), dtype=np.int64, count=len(f)))
    return out


def fit(pages: list[tuple[str, str, list[str]]]) -> np.ndarray | None:
    """Logistic regression by AdaGrad over the lines that lie under a known path; None without such lines."""
    xs: list[np.ndarray] = []
    ys: list[float] = []
    for markdown, source, good in pages:
        found = aligned(markdown, source)
        known = set(good)
        for (_, _, path), f in zip(found, features([(i, x) for i, x, _ in found])):
            if path and path[0] != "=":
                xs.append(f)
                ys.append(0.0 if path in known else 1.0)
    if len(set(ys)) < 2:
        return None
    w, g = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    order = np.random.RandomState(7)
    for _ in range(PASSES):
        for k in order.permutation(len(xs)):
            f = xs[k]
            d = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[f].sum()))))) - ys[k]
            if abs(d) > 1e-3:
                g[f] += d * d
                w[f] -= 0.2 * d / np.sqrt(g[f])
    return w.astype(np.float32)


def _by_cues(lines: list[tuple[int, str]]) -> list[bool]:
    """Without any labelled page: a line of links into its own site alone is outside the body."""
    out = []
    for _, x in lines:
        links = LINK.findall(x)
        out.append(bool(links) and all(not h.startswith("http") for _, h in links) and not STOP.search(x))
    return out


def outside(markdown: str, source: str | None, good: list[str] | None, w: np.ndarray | None) -> list[tuple[int, str, bool]]:
    """(line_no, line, outside the main body) of every non-blank line."""
    found = aligned(markdown, source)
    known = set(good) if good is not None else None
    told = [bool(p) and p[0] != "=" and known is not None for _, _, p in found]
    if all(told):
        return [(i, x, p not in known) for i, x, p in found]
    lines = [(i, x) for i, x, _ in found]
    guess = _by_cues(lines) if w is None else [float(w[f].sum()) > 0 for f in features(lines)]
    return [(i, x, p not in known if t else o) for (i, x, p), t, o in zip(found, told, guess)]


def line_model(pages: DataFrame, good: DataFrame) -> np.ndarray | None:
    """Fit the line model on about SAMPLE_PAGES pages of up to SAMPLE_BYTES, chosen by hash, at every size."""
    small = pages.filter(F.octet_length("markdown") + F.octet_length("clean_html") <= SAMPLE_BYTES)
    wrapped = small.filter(F.col("clean_html").rlike(r"(?i)<(div|nav|article|aside|section|main|footer|header)\b"))
    some = bounded_sample(wrapped.select("scrape_id", "site", "markdown", "clean_html"), "scrape_id", SAMPLE_PAGES)
    some = some.withColumn("h", F.xxhash64("scrape_id"))
    joined = some.join(good, some["site"].eqNullSafe(good["site"])).select("h", "markdown", "clean_html", "content_paths")
    return fit([(r[1], r[2], list(r[3])) for r in sorted(joined.collect(), key=lambda r: (r[0], r[1]))])


class Bodies:
    """The fitted operator over one table of pages: call lines() or texts()."""

    def __init__(self, pages: DataFrame):
        self.pages = records(pages)
        self.good = cut(content_paths(self.pages))
        # checked size: the content paths are broadcast up to BROADCAST_BYTES; beyond it a sort-merge join, split by
        # the engine where a site is skewed
        size = self.good.agg(F.sum(F.length("site") + F.length(F.array_join("content_paths", " ")) + 64)).first()[0] or 0
        if size <= BROADCAST_BYTES:
            self.good = F.broadcast(self.good)
        w = line_model(self.pages, self.good)
        self.weights = pages.sparkSession.sparkContext.broadcast(w)

    def _joined(self, *columns: str, pages: DataFrame | None = None) -> DataFrame:
        own = ["scrape_id", "site", "markdown", "clean_html", *(c for c in columns if c != "site")]
        p = (self.pages if pages is None else pages).select(*own).withColumnRenamed("site", "_site")
        return p.join(self.good, p["_site"].eqNullSafe(self.good["site"]), "left").select(
            *(c if c != "site" else F.col("_site").alias("site") for c in own), "content_paths"
        )

    def lines(self) -> DataFrame:
        """(scrape_id, line_no) of every non-blank line outside the main body."""
        weights = self.weights

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = weights.value
            for b in batches:
                ids, nos = [], []
                for sid, md, src, good in zip(b["scrape_id"], b["markdown"], b["clean_html"], b["content_paths"]):
                    for no, _, out in outside(md, src, good, w):
                        if out:
                            ids.append(sid)
                            nos.append(no)
                yield pd.DataFrame({"scrape_id": ids, "line_no": nos})

        return self._joined().drop("site").mapInPandas(run, "scrape_id bigint, line_no int").distinct()

    def apply(self, columns: list[str], schema: str, fn, pages: DataFrame | None = None) -> DataFrame:
        """fn(batch, bodies) -> DataFrame over the rows, where bodies holds the non-blank lines of each main body.

        The text is cut and used in one Python stage, so it does not travel to the JVM and back.
        """
        weights = self.weights

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = weights.value
            for b in batches:
                bodies = [
                    [x for _, x, out in outside(md, src, good, w) if not out]
                    for md, src, good in zip(b["markdown"], b["clean_html"], b["content_paths"])
                ]
                yield fn(b, bodies)

        return self._joined(*columns, pages=pages).mapInPandas(run, schema)

    def texts(self) -> DataFrame:
        """(scrape_id, body, removed): every record with its main body only; records without text keep a null body."""
        weights = self.weights

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w = weights.value
            for b in batches:
                body, n = [], []
                for md, src, good in zip(b["markdown"], b["clean_html"], b["content_paths"]):
                    drop = {no for no, _, out in outside(md, src, good, w) if out}
                    body.append("\n".join(x for i, x in enumerate(md.split("\n"), 1) if i not in drop).strip("\n"))
                    n.append(len(drop))
                yield pd.DataFrame({"scrape_id": b["scrape_id"], "body": body, "removed": n})

        return self._joined().drop("site").mapInPandas(run, "scrape_id bigint, body string, removed int").dropDuplicates(["scrape_id"])
