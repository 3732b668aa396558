"""Problem 5: keyword-stuffed pages and link lists.

The text of a page is compressed in blocks; the ratio is set against that of running text of the same language and
length class, so that short pages and two-byte scripts are not mistaken.  The expected ratio is the median over distinct
bodies that are dense in sentences, so suspected pages and copies do not set what they are measured by.  A ratio below
EXTREME of it flags a page; low sentence density and repeated words confirm it.

Lists of bare links and tags hold names that do not repeat, but their form does: of the form of a page (words and numbers
as one sign each) the ratio is taken in the same way, FORM of that of running text flags it, and links without
explaining sentences or tags in half of it confirm it.

Defined cases: null or empty markdown is no case; one ordinary sentence at the start is set aside first; a class with
under PEERS such bodies takes the median of its length over all languages, and without PEERS there the fixed CURVE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pagestats import page_stats


#: A page is redundant below this share of the expected ratio; a median needs so many bodies of so many sentences in
#: 100 words, and of so large a share of characters in sentences.
EXTREME, FORM, PEERS, DENSE, PROSE = 0.75, 0.95, 20, 7.8, 0.8
#: The share of words that stand four times or more, which tells keywords from numbered entries.
REPEATED = 0.2
#: The ratio of running text by the binary order of its bytes; the last one holds for all longer texts.
CURVE = {5: 1.1, 6: 0.95, 7: 0.76, 8: 0.62, 9: 0.54, 10: 0.52}
#: The same of its form.
FORM_CURVE = {3: 1.23, 4: 0.81, 5: 0.53, 6: 0.33, 7: 0.24, 8: 0.18, 9: 0.14, 10: 0.12}


def _density() -> Column:
    return 100.0 * F.col("n_sentences_rest") / F.greatest(F.col("content_words"), F.lit(1))


def _curve(values: dict[int, float], size: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.element_at(known, F.greatest(F.lit(min(values)), F.least(F.lit(max(values)), size)))


def with_expected(stats: DataFrame) -> DataFrame:
    """stats with expected and expected_form, the block-wise ratios of running text of the page's language and length class."""
    order = lambda c: F.floor(F.log2(F.col(c) + 1)).cast("int")
    s = stats.withColumn("size_class", order("packed_bytes")).withColumn("form_class", order("form_bytes"))
    share = F.col("prose_chars") / F.greatest(F.col("prose_chars") + F.col("item_chars"), F.lit(1))
    one = s.filter((_density() >= DENSE) & (share >= PROSE)).groupBy("line_key").agg(F.min(F.struct("scrape_id", "lang", "size_class", "packed", "form_class", "form")).alias("p")).select("p.*")
    middle = lambda c: F.when(F.count(F.lit(1)) >= PEERS, F.percentile_approx(c, 0.5, 1000))
    by_both = one.filter("lang <> ''").groupBy("lang", "size_class").agg(middle("packed").alias("m2"))
    by_size = one.groupBy("size_class").agg(middle("packed").alias("m1"))
    by_form = one.groupBy("form_class").agg(middle("form").alias("m3"))
    # the tables have at most a few hundred rows: languages times binary orders of magnitude
    return (
        s.join(F.broadcast(by_both), ["lang", "size_class"], "left").join(F.broadcast(by_size), "size_class", "left").join(F.broadcast(by_form), "form_class", "left")
        .withColumn("expected", F.coalesce("m2", "m1", _curve(CURVE, F.col("size_class"))))
        .withColumn("expected_form", F.coalesce("m3", _curve(FORM_CURVE, F.col("form_class")))).drop("m1", "m2", "m3")
    )


def is_spam() -> Column:
    enough, code = F.col("content_words") >= 12, F.col("code_ratio") > 0.035
    stuffed = (F.col("packed") < EXTREME * F.col("expected")) & (_density() < DENSE) & (F.col("repetition") >= REPEATED) & enough & ~code
    bare = (F.col("n_links") >= 4) & (2 * F.col("linked_lines") >= F.col("n_lines_rest")) & (F.col("explained") <= 0.3 * F.col("linked_lines"))
    tags = (F.col("tags") >= 5) & (2 * F.col("tags") >= F.col("tokens"))
    return stuffed | ((F.col("form") < FORM * F.col("expected_form")) & (bare | tags))


def spam_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .residue import is_residue, with_evidence

    return with_evidence(with_expected(page_stats(spark, sf_dir))).filter(is_spam() & ~is_residue()).select("scrape_id")
