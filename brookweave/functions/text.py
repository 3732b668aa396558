"""Text expressions: paragraphs, cutting, fences, terms.  All but the walk over pages stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a search query.
QUERY_STOPWORDS = "vs versus and or the a an of to for in on with is are how what why best using use".split()


def collapse(text: Column) -> Column:
    """Runs of any Unicode white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def take_chars(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def slice_at(text: Column, offset: Column) -> Column:
    """The text from a code-point offset on."""
    return F.substr(text, offset + 1)


def truncate(text: Column, limit: int) -> Column:
    """At most limit code points; the last blank line is preferred if more than half of the bytes stay."""
    limit = max(1, limit)
    head = F.substring(text, 1, limit)
    back = F.locate("\n\n", F.reverse(head))
    kept = F.substr(text, F.lit(1), F.lit(limit) - back - 1)
    good = (back > 0) & (F.octet_length(kept) * 2 > F.octet_length(head))
    return F.when(F.length(text) <= limit, text).when(good, kept).otherwise(head)


def _pages(text: str, limit: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while True:
        head = text[at : at + limit]
        if len(text) - at > limit:
            cut = head.rfind("\n\n")
            if cut > 0 and len(head[:cut].encode()) * 2 > len(head.encode()):
                head = head[:cut]
        out.append((at, len(head)))
        at += len(head)
        if at >= len(text):
            return out


def walk(text: Column, limit: int) -> Column:
    """array of struct(offset, length): every page that truncate gives until the end; one pass over the text in Python,
    as a fold that takes substrings from the front in the JVM is quadratic."""
    limit = max(1, limit)

    @F.pandas_udf("array<struct<offset: bigint, length: bigint>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [{"offset": a, "length": n} for a, n in _pages(t, limit)])

    return run(text)


def _fence_step(state: Column, line: Column) -> Column:
    """One line of the fence machine: state is struct(ch, len), '' while no fence is open."""
    trimmed = F.ltrim(line)
    run = F.regexp_extract(trimmed, r"^(`{3,}|~{3,})", 1)
    rest = F.trim(F.substr(trimmed, F.length(run) + 1, F.length(trimmed)))
    ch, n = F.substring(run, 1, 1), F.length(run)
    shut = F.struct(F.lit("").alias("ch"), F.lit(0).alias("len"))
    opened = F.struct(ch.alias("ch"), n.alias("len"))
    return (
        F.when(n == 0, state)
        .when(state["ch"] == "", opened)
        .when((state["ch"] == ch) & (n >= state["len"]) & (rest == ""), shut)
        .otherwise(state)
    )


def fence_state(text: Column) -> Column:
    """struct(ch, len) of the fence that is open at the end of the text."""
    start = F.struct(F.lit("").alias("ch"), F.lit(0).alias("len"))
    return F.aggregate(F.split(text, "\n", -1), start, _fence_step)


def close_fence(text: Column) -> Column:
    """The text with a closing marker where a fence is open at its end."""
    state = fence_state(text)
    bare = F.regexp_replace(text, r"\n+$", "")
    return F.when(state["len"] > 0, F.concat(bare, F.lit("\n"), F.expr("''"), F.repeat(state["ch"], state["len"]))).otherwise(text)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines; a fenced block is one, and an unclosed fence takes the rest.  '' gives ['']."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("cur"), F.lit("").alias("ch"), F.lit(0).alias("len")
    )

    def step(s: Column, part: Column) -> Column:
        joined = F.when(s["cur"].isNull(), part).otherwise(F.concat(s["cur"], F.lit("\n\n"), part))
        state = F.aggregate(F.split(part, "\n", -1), F.struct(s["ch"].alias("ch"), s["len"].alias("len")), _fence_step)
        closed = state["len"] == 0
        return F.struct(
            F.when(closed, F.array_append(s["done"], joined)).otherwise(s["done"]).alias("done"),
            F.when(closed, F.lit(None).cast("string")).otherwise(joined).alias("cur"),
            state["ch"].alias("ch"),
            state["len"].alias("len"),
        )

    folded = F.aggregate(F.split(text, "\n\n", -1), start, step)
    return F.when(~text.contains("```") & ~text.contains("~~~"), F.split(text, "\n\n", -1)).otherwise(
        F.when(folded["cur"].isNull(), folded["done"]).otherwise(F.array_append(folded["done"], folded["cur"]))
    )


def focus_terms(query: Column) -> Column:
    """Lower-cased words of a query of more than two bytes, without marks around them; repeated ones stay."""
    words = F.transform(F.split(query, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.filter(words, lambda w: F.octet_length(w) > 2)


def query_terms(query: Column) -> Column:
    """Distinct words of a search query in order, without stop words and bare numbers."""
    words = F.transform(F.split(query, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    stop = F.array(*map(F.lit, QUERY_STOPWORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~F.array_contains(stop, w) & ~w.rlike(r"^\d+$")))


def coverage(terms: Column, hay: Column) -> Column:
    """The share of terms that the lower-cased text contains; 0 without terms."""
    hit = F.size(F.filter(terms, lambda t: F.contains(hay, t))).cast("double")
    return F.when(F.size(terms) > 0, hit / F.size(terms)).otherwise(F.lit(0.0))


def count_of(text: Column, term: Column) -> Column:
    """Occurrences of a term that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def headings(markdown: Column, most: int = 20) -> Column:
    return F.slice(F.filter(F.split(markdown, "\n", -1), lambda x: F.ltrim(x).startswith("#")), 1, most)


def token_estimate(text: Column) -> Column:
    return F.expr("0").cast("bigint") + F.floor(F.length(text) / 4)


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shell_quote(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def table_artifact(text: Column) -> Column:
    """Text that a table was flattened into: many pipes against letters, and a pipe before two blanks."""
    pipes = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    alpha = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (pipes > 20) & (alpha > 0) & (pipes / F.greatest(alpha, F.lit(1)) > 0.05) & F.contains(text, F.lit("|  "))
