"""Enrichment of raw listing text and the ingest job: extract, score, gate, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.functions import text
from bazaarlens.functions.scoring import SCORE_V2, ScoreRule, scored
from bazaarlens.operators.latest import upsert
from bazaarlens.plans.pages import extract_listings


def enrich_listings(df: DataFrame, category_mode: str = "substring") -> DataFrame:
    """Standardised fields read from title and description.

    Existing columns keep their values; only missing fields are filled in.
    """
    # The joined text is its own column: many patterns read it, it is built once.
    names = list(df.columns)
    df = df.withColumn("_text", F.concat_ws(" ", "title", "description"))
    both = F.col("_text")
    found = {
        "title": text.clean_title(F.col("title")),
        "category": text.category(F.col("title"), category_mode),
        "material": text.primary_material(both),
        "materials": text.all_materials(both),
        "main_stone": text.primary_gemstone(both),
        "stone_color": text.stone_color(both),
        "stone_clarity": text.stone_clarity(both),
        "stone_cut": text.stone_cut(both),
        "stone_carat": text.stone_carat(both),
        "dimensions": text.dimensions(both),
        "weight": text.weight(both),
        "description_length": F.length("description"),
    }
    if "condition" in df.columns:
        df = df.withColumn("condition", text.standard_condition(F.col("condition")))
    fresh = {
        name: F.coalesce(F.col(name), col) if name in df.columns and name != "title" else col
        for name, col in found.items()
    }
    out = df.withColumns(fresh)
    size = text.size_for(both, F.col("category"))
    out = out.withColumn("size", F.coalesce("size", size) if "size" in names else size)
    return out.drop("_text")


def ingest(
    pages: DataFrame, rule: ScoreRule = SCORE_V2, keep_incomplete: bool = False
) -> DataFrame:
    """Scored listings of a page table with the gate's verdict in ``accepted``.

    ``keep_incomplete`` sends pages without title or price through the gate, too.
    """
    listings = extract_listings(pages, keep_incomplete)
    if "description" not in listings.columns:
        listings = listings.withColumn("description", F.lit(None).cast("string"))
    return scored(listings, rule)


def split_gate(scored_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return scored_rows.where("accepted"), scored_rows.where("NOT accepted")


def merge(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """Current table after insert-or-replace of accepted rows."""
    return upsert(existing, accepted)
