"""Problem 1: per-document text quality statistics and the pages that are not running prose.

Statistics come from one Python stage per batch of pages, since the body is cut there (words, word length, symbols, line
ends, bullets, common words of the page's language); fixed-threshold rules then name every reason for which a page fails.
The thresholds are those published for web corpora (mean word length 3 to 10, symbol share 0.1, bullet lines 0.9,
line-end punctuation 0.12, short lines 0.67, repeated lines 0.3, common words), applied where they hold in every language.

Which reasons make a page no running prose follows from the definition: NOT_PROSE.  Few words are none (short texts count
as prose), nor are bullets whose entries are sentences, nor words and letters that a wrong encoding alone changes.  Line
ends and short lines choose most pages; `one_sentence` finds entries after a single introductory sentence, `keywords` is
problem 5.

Defined cases: null or empty markdown has no row; a body without any line counts as prose (nothing shows otherwise);
repeated deliveries give one row; a language without common words (ja, zh) skips that rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pagestats import page_stats
from .residue import is_residue
from .spam import is_spam

#: The reasons that tell lists, tables and junk from prose.
NOT_PROSE = ("line_ends", "short_lines", "one_sentence", "keywords")


def one_sentence() -> Column:
    """Entries or rows, after one sentence at most."""
    return (F.col("item_chars") > 0) & (F.col("n_sentences") <= 1) & (F.col("n_items") >= 4)


def reasons() -> Column:
    rule = lambda name, bad: F.when(bad, F.lit(name))
    spaced = ~F.col("lang").isin("ja", "zh")
    return F.array_compact(
        F.array(
            rule("few_words", F.col("n_words") < 50),
            rule("word_length", spaced & ((F.col("mean_word") < 3) | (F.col("mean_word") > 10))),
            rule("symbols", F.col("symbol_ratio") > 0.1),
            rule("bullets", F.col("bullet_lines") > 0.9),
            rule("line_ends", F.col("punct_lines") < 0.12),
            rule("short_lines", F.col("short_lines") > 0.67),
            rule("repeated_lines", F.col("dup_lines") > 0.3),
            rule("alphabetic_words", F.col("alpha_words") < 0.8),
            rule("common_words", spaced & (F.col("common_share") < 0.05)),
            rule("one_sentence", one_sentence()),
            rule("keywords", is_spam()),
        )
    )


def judged(stats: DataFrame) -> DataFrame:
    from .residue import with_evidence
    from .spam import with_expected

    return with_evidence(with_expected(stats))


def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = judged(page_stats(spark, sf_dir))
    return s.select(
        "scrape_id", "lang", "n_words", "mean_word", "symbol_ratio", "punct_lines", "bullet_lines", "common_share", "n_sentences",
        reasons().alias("reasons"),
    )


def not_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = judged(page_stats(spark, sf_dir))
    return s.filter(F.arrays_overlap(reasons(), F.array(*map(F.lit, NOT_PROSE))) & ~is_residue()).select("scrape_id")
