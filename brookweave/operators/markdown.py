"""Line folds over markdown and README text that built-in expressions cannot carry: one Arrow UDF each."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RULE = re.compile(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$")
BADGE = re.compile(r"\[?!\[[^\]]*\]\([^)]*\)(?:\]\([^)]*\))?")
LINKDEF = re.compile(r"^\s*\[[^\]]+\]:\s*\S+")
TAGLINE = re.compile(r"^\s*(?:</?[A-Za-z][^>]*>\s*)+$")
WRAP = re.compile(r"</?(?:p|div|center|picture|source|br|span|details|summary|kbd|sub|sup|h[1-6]|img|a|b|i|em|strong)\b[^>]*>", re.I)


def clean(md: str | None) -> str | None:
    """Blank runs of three or more become one, runs of three blanks inside a line one; rules without text before them
    go; fenced and indented code stays as it is."""
    if md is None:
        return None
    out: list[str] = []
    fence, blanks = "", 0
    for line in md.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            out.append(line)
            if mark and mark[1][0] == fence:
                fence = ""
            continue
        if not line.strip():
            blanks += 1
            continue
        if RULE.match(line) and not (out and out[-1].strip() and not blanks):
            if not out:
                continue
            if not out[-1].strip() or RULE.match(out[-1]):
                continue
        if blanks and out:
            out.extend([""] * (1 if blanks >= 3 else blanks))
        blanks = 0
        if mark:
            fence = mark[1][0]
        out.append(line if mark or line.startswith(("    ", "\t")) else re.sub(r"(?<=\S)[ \t]{3,}", " ", line))
    return "\n".join(out)


def clean_readme(md: str | None) -> str | None:
    """A README without comments, link definitions, badges, wrapper tags and lines of mere markup; code stays."""
    if md is None:
        return None
    out: list[str] = []
    fence, comment = "", False
    for line in md.split("\n"):
        mark = re.match(r"\s*(`{3,}|~{3,})", line)
        if fence:
            out.append(line)
            if mark and mark[1][0] == fence:
                fence = ""
            continue
        if not comment and mark:
            fence = mark[1][0]
            out.append(line)
            continue
        if comment:
            end = line.find("-->")
            if end < 0:
                continue
            line, comment = line[end + 3 :], False
        line = re.sub(r"<!--.*?-->", "", line)
        if "<!--" in line:
            line, comment = line[: line.index("<!--")], True
        if LINKDEF.match(line) or TAGLINE.match(line) and line.strip():
            continue
        bare = WRAP.sub("", BADGE.sub("", line))
        if line.strip() and not re.search(r"\w", bare):
            continue
        if bare.strip() or not out or out[-1].strip():
            out.append(bare.rstrip())
    return "\n".join(out).strip("\n")


@F.pandas_udf(StringType())
def clean_markdown(md: pd.Series) -> pd.Series:
    return md.map(clean)


@F.pandas_udf(StringType())
def readme(md: pd.Series) -> pd.Series:
    return md.map(clean_readme)
