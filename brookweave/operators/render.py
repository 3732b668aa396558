"""Text and JSON forms of results: page sections, failures, search lists, lookups.

Every form is a column expression over one row, so a sink writes what it gets without a shuffle.  Null titles, tiers and
counts stand as empty text, false or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import shell_quote

PROGRAM = "brookweave"


@dataclass
class Page:
    """The columns of a page that its section shows."""

    url: Column
    title: Column
    markdown: Column
    tier: Column
    content_ok: Column
    total_chars: Column
    next_offset: Column
    focused_chars: Column

    @classmethod
    def of(cls, prefix: str = "") -> Page:
        return cls(*(F.col(prefix + n) for n in ("url", "title", "markdown", "tier", "content_ok", "total_chars", "next_offset", "focused_chars")))


def with_hint(p: Page, focus: str | None, max_chars: int) -> Column:
    """The page's text and, where it was cut, the command that gives the rest under the same focus and size."""
    n = p.next_offset.cast("string")
    command = F.concat(F.lit(f"{PROGRAM} scrape "), shell_quote(p.url), F.lit(" --offset "), n, F.lit(f" --max-chars {max_chars}"))
    if focus is not None:
        command = F.concat(command, F.lit(" --focus "), shell_quote(F.lit(focus)))
    of = F.when(p.focused_chars > 0, F.concat(F.lit(" of "), p.focused_chars.cast("string"))).otherwise(F.lit(""))
    hint = F.concat(F.lit("\n\n<!-- truncated at "), n, of, F.lit(" chars; more: "), command, F.lit(" -->"))
    return F.concat(p.markdown, F.coalesce(hint, F.lit("")))


def _meta(p: Page) -> Column:
    return F.concat(
        F.lit("<!-- tier: "), F.coalesce(p.tier, F.lit("")), F.lit(" content_ok: "), F.coalesce(p.content_ok, F.lit(False)).cast("string"), F.lit(" chars: "),
        F.coalesce(p.total_chars, F.lit(0)).cast("string"), F.lit(" -->\n\n"),
    )


def page_section(p: Page, focus: str | None, max_chars: int) -> Column:
    """A single page: title, meta comment, text."""
    return F.concat(F.lit("# "), F.coalesce(p.title, F.lit("")), F.lit("\n"), _meta(p), with_hint(p, focus, max_chars))


def failed_section(url: Column, error: Column) -> Column:
    return F.concat(F.lit("## "), url, F.lit("\n<!-- error: "), error, F.lit(" -->\n\n_fetch failed_\n"))


def batch_section(p: Page, error: Column, focus: str | None, max_chars: int) -> Column:
    """One page of a batch under its address, or its failure."""
    good = F.concat(F.lit("## "), p.url, F.lit("\n"), _meta(p), with_hint(p, focus, max_chars), F.lit("\n"))
    return F.when(error.isNotNull(), failed_section(p.url, error)).otherwise(good)


def error_json(url: Column, error: Column) -> Column:
    return F.to_json(F.struct(F.lit(False).alias("content_ok"), error.alias("error"), url.alias("url")))


def hit_line(number: Column, title: Column, url: Column, snippet: Column) -> Column:
    """A search hit in a list; an empty snippet adds no line."""
    text = F.coalesce(snippet, F.lit(""))
    more = F.when(text != "", F.concat(F.lit("\n   "), text)).otherwise(F.lit(""))
    return F.concat(number.cast("string"), F.lit(". "), F.coalesce(title, F.lit("")), F.lit(" — "), url, more)


def search_head(query: Column, warning: Column) -> Column:
    return F.concat(F.lit("# "), query, F.coalesce(F.concat(F.lit("\n<!-- warning: "), warning, F.lit(" -->")), F.lit("")))


def lookup_line(spec: Column, text: Column, error: Column) -> Column:
    """One lookup's text, or its error with the spec that failed."""
    return F.coalesce(text, F.concat(F.lit("error: "), spec, F.lit(": "), F.coalesce(error, F.lit("no answer"))))
