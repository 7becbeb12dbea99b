"""Exports of listings to common file formats through the DataFrame writer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bazaarlens.operators.filters import ListingFilter, apply_filter
from bazaarlens.sources.store import MICROS, append_history, read_history, serialise_nested

FORMATS = ("csv", "json", "jsonl", "xml", "parquet", "jdbc")
HISTORY = (
    "export_id string, format string, path string, record_count long, status string, "
    "error string, exported_at timestamp"
)
# List columns that flatten, columns left out by default, summary columns.
LIST_FIELDS = ["materials", "features", "tags", "accent_stones", "keywords", "custom_categories"]
METADATA_FIELDS = ["metadata", "extraction_metadata", "processing_flags"]
RAW_FIELDS = ["raw_data"]
SUMMARY_FIELDS = [
    "listing_id", "title", "price", "currency", "brand", "seller_name", "condition",
    "main_stone", "size", "image_count", "watchers", "views", "data_completeness_score",
    "scraped_at", "url",
]


@dataclass
class ExportOptions:
    format: str = "csv"
    delimiter: str = ","
    quote_all: bool = False
    encoding: str = "UTF-8"
    header: bool = True
    compression: str | None = None
    include: list[str] | None = None
    exclude: list[str] | None = None
    rename: dict[str, str] = field(default_factory=dict)
    include_metadata: bool = False
    include_raw: bool = False
    max_records: int | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    xml_root: str = "listings"
    xml_row: str = "listing"
    jdbc: dict[str, str] = field(default_factory=dict)
    partition_by: list[str] = field(default_factory=list)


def check_options(options: ExportOptions) -> list[str]:
    errors = []
    if options.format not in FORMATS:
        errors.append(f"Unsupported format: {options.format}")
    if options.max_records is not None and options.max_records <= 0:
        errors.append("max_records must be positive")
    if options.format == "csv" and len(options.delimiter) != 1:
        errors.append("CSV delimiter must be one character")
    if options.include and options.exclude:
        errors.append("Give included or excluded fields, not both")
    if options.format == "jdbc" and not {"url", "dbtable"} <= set(options.jdbc):
        errors.append("A JDBC export needs url and dbtable")
    return errors


def choose_fields(df: DataFrame, options: ExportOptions) -> DataFrame:
    if options.include:
        return df.select(*[c for c in df.columns if c in options.include])
    if options.exclude:
        return df.drop(*options.exclude)
    dropped = [] if options.include_metadata else list(METADATA_FIELDS)
    dropped += [] if options.include_raw else RAW_FIELDS
    return df.drop(*dropped)


def flatten_lists(df: DataFrame, names: list[str] = LIST_FIELDS) -> DataFrame:
    """JSON-array text and array columns as one ``', '``-joined text.

    Text that is not a JSON array stays as it is.
    """
    kinds = dict(df.dtypes)
    flat = {}
    for name in names:
        kind = kinds.get(name, "")
        if kind.startswith("array"):
            flat[name] = F.array_join(F.col(name), ", ")
        elif kind == "string":
            array = F.when(
                F.trim(name).startswith("["), F.from_json(name, "array<string>")
            )
            flat[name] = F.coalesce(F.array_join(array, ", "), F.col(name))
    return df.withColumns(flat) if flat else df


def prepared(df: DataFrame, options: ExportOptions) -> DataFrame:
    """Field choice, renaming, row hook and flattening in export order."""
    out = df if options.max_records is None else df.limit(options.max_records)
    out = choose_fields(out, options)
    # List fields are matched by their own names, so they flatten before renaming.
    out = flatten_lists(out)
    if options.rename:
        out = out.withColumnsRenamed(options.rename)
    return out.transform(options.transform) if options.transform else out


def export(df: DataFrame, path: str, options: ExportOptions | None = None) -> dict:
    """Write the rows and report how many; no rows is a failed export."""
    options = options or ExportOptions()
    errors = check_options(options)
    if errors:
        return {"success": False, "error": "; ".join(errors), "record_count": 0}
    seen = Observation(f"export_{uuid.uuid4().hex}")
    rows = prepared(df, options).observe(seen, F.count(F.lit(1)).alias("rows"))
    fmt = "json" if options.format == "jsonl" else options.format
    if fmt in ("csv", "xml", "jdbc"):
        rows = serialise_nested(rows)  # these formats only hold flat values
    writer = rows.write.mode("overwrite").format(fmt)
    if fmt in ("csv", "json", "xml"):
        writer = writer.option("timestampFormat", MICROS)
    if options.compression and fmt != "jdbc":
        writer = writer.option("compression", options.compression)
    if fmt == "csv":
        writer = writer.options(
            sep=options.delimiter, header=options.header, nullValue="", emptyValue="",
            quoteAll=options.quote_all, encoding=options.encoding, escape='"',
        )
    elif fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    elif fmt == "xml":
        writer = writer.options(rootTag=options.xml_root, rowTag=options.xml_row)
    if fmt == "jdbc":
        writer.mode("append").options(**options.jdbc).save()
    else:
        if options.partition_by:
            # an export is replaced as a whole, whatever the session says about partitions
            writer = writer.option("partitionOverwriteMode", "static")
            writer = writer.partitionBy(*options.partition_by)
        writer.save(path)
    count = seen.get["rows"]
    if count == 0:
        return {"success": False, "error": "No records found matching criteria", "record_count": 0}
    return {"success": True, "path": path, "format": options.format, "record_count": count}


def export_listings(
    listings: DataFrame, criteria: ListingFilter, path: str, options: ExportOptions | None = None
) -> dict:
    return export(apply_filter(listings, criteria), path, options)


HIGH_QUALITY = ListingFilter(min_quality_score=0.8, is_validated=True, has_images=True)


def high_quality_rows(listings: DataFrame) -> DataFrame:
    return prepared(apply_filter(listings, HIGH_QUALITY), ExportOptions())


def category_rows(listings: DataFrame, category: str) -> DataFrame:
    chosen = apply_filter(listings, ListingFilter(category=category, is_validated=True))
    return prepared(chosen, ExportOptions(include=SUMMARY_FIELDS))


def export_high_quality(listings: DataFrame, path: str, fmt: str = "csv") -> dict:
    return export(apply_filter(listings, HIGH_QUALITY), path, ExportOptions(format=fmt))


def export_category_summary(listings: DataFrame, category: str, path: str, fmt: str = "csv") -> dict:
    chosen = apply_filter(listings, ListingFilter(category=category, is_validated=True))
    return export(chosen, path, ExportOptions(format=fmt, include=SUMMARY_FIELDS))


def log_export(spark, log_path: str, result: dict, fmt: str, at: datetime) -> None:
    status = "completed" if result["success"] else "failed"
    row = (uuid.uuid4().hex, fmt, result.get("path"), result["record_count"], status,
           result.get("error"), at)
    append_history(spark, log_path, HISTORY, [row])


def export_history(spark, log_path: str, rows: int = 10) -> DataFrame:
    return read_history(spark, log_path, HISTORY).orderBy(F.desc("exported_at")).limit(rows)
