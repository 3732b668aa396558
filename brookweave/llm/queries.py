"""The pN_ queries, each over its whole tables with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import garbled, neardup, packing, quality, repeats, residue, spam, splitting, tokens
from .body import Bodies
from .common import table


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "scrape_results")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": quality.not_prose,
    "p1_stats": quality.quality_stats,
    "p2_found": lambda s, d: neardup.NearDuplicates(_pages(s, d)).pairs(),
    "p2_classes": lambda s, d: neardup.NearDuplicates(_pages(s, d)).membership(),
    "p2_groups": lambda s, d: neardup.NearDuplicates(_pages(s, d)).groups(),
    "p3_found": lambda s, d: repeats.repeated_lines(_pages(s, d)),
    "p3_clean": lambda s, d: repeats.without_repeats(_pages(s, d)),
    "p4_found": lambda s, d: garbled.restored(s, d).select("src", "rec_id", "field"),
    "p4_restored": garbled.restored,
    "p5_found": spam.spam_pages,
    "p6_found": residue.residue_pages,
    "p7_found": lambda s, d: Bodies(_pages(s, d)).lines(),
    "p7_bodies": lambda s, d: Bodies(_pages(s, d)).texts(),
    "p8_ids": lambda s, d: tokens.encoded(table(s, d, "documents")),
    "p8_round_trip": lambda s, d: tokens.round_trip(table(s, d, "documents")).groupBy("same").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")),
    "p9_pack": packing.pack,
    "p9_fill": packing.fill,
    "p10_pieces": splitting.split,
}

#: p9's total must be the sum of all token counts whatever the packing; the others have no SQL form: they rest on
#: parsing, fitted models, sketches or a vocabulary, and are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {}
