"""Explicit schemas of the record tables; nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, LongType, MapType, StringType, StructField, StructType,
    TimestampType,
)

TEXT, NUMBER, COUNT = StringType(), DoubleType(), LongType()
FLAG, TIME = BooleanType(), TimestampType()
TEXTS, PAIRS = ArrayType(TEXT), MapType(TEXT, TEXT)

# The columns of each table in their order.
LISTINGS = StructType(
    [
        StructField("listing_id", TEXT),
        StructField("url", TEXT),
        StructField("marketplace_item_id", TEXT),
        StructField("title", TEXT),
        StructField("price", NUMBER),
        StructField("original_price", NUMBER),
        StructField("buy_it_now_price", NUMBER),
        StructField("starting_bid", NUMBER),
        StructField("reserve_price", NUMBER),
        StructField("currency", TEXT),
        StructField("condition", TEXT),
        StructField("availability", TEXT),
        StructField("quantity_available", COUNT),
        StructField("quantity_sold", COUNT),
        StructField("seller_name", TEXT),
        StructField("seller_rating", NUMBER),
        StructField("seller_feedback_count", COUNT),
        StructField("seller_feedback_percentage", NUMBER),
        StructField("seller_location", TEXT),
        StructField("seller_store_name", TEXT),
        StructField("seller_level", TEXT),
        StructField("category", TEXT),
        StructField("subcategory", TEXT),
        StructField("marketplace_category", TEXT),
        StructField("custom_categories", TEXTS),
        StructField("brand", TEXT),
        StructField("manufacturer", TEXT),
        StructField("designer", TEXT),
        StructField("collection", TEXT),
        StructField("style", TEXT),
        StructField("era", TEXT),
        StructField("country_origin", TEXT),
        StructField("material", TEXT),
        StructField("materials", TEXTS),
        StructField("metal_purity", TEXT),
        StructField("metal_stamp", TEXT),
        StructField("plating", TEXT),
        StructField("finish", TEXT),
        StructField("size", TEXT),
        StructField("ring_size", TEXT),
        StructField("length", TEXT),
        StructField("width", TEXT),
        StructField("thickness", TEXT),
        StructField("weight", TEXT),
        StructField("carat_weight", NUMBER),
        StructField("dimensions", TEXT),
        StructField("main_stone", TEXT),
        StructField("main_stone_details", PAIRS),
        StructField("stone_color", TEXT),
        StructField("stone_clarity", TEXT),
        StructField("stone_cut", TEXT),
        StructField("stone_shape", TEXT),
        StructField("stone_carat", TEXT),
        StructField("stone_certification", TEXT),
        StructField("accent_stones", TEXTS),
        StructField("description", TEXT),
        StructField("description_html", TEXT),
        StructField("features", TEXTS),
        StructField("specifications", PAIRS),
        StructField("tags", TEXTS),
        StructField("keywords", TEXTS),
        StructField("item_number", TEXT),
        StructField("listing_type", TEXT),
        StructField("listing_format", TEXT),
        StructField("listing_status", TEXT),
        StructField("listing_duration", TEXT),
        StructField("watchers", COUNT),
        StructField("views", COUNT),
        StructField("page_views", COUNT),
        StructField("bids", COUNT),
        StructField("bid_count", COUNT),
        StructField("max_bid", NUMBER),
        StructField("reserve_met", FLAG),
        StructField("time_left", TEXT),
        StructField("best_offer", FLAG),
        StructField("price_drop", NUMBER),
        StructField("discount_percentage", NUMBER),
        StructField("shipping_cost", NUMBER),
        StructField("ships_from", TEXT),
        StructField("ships_to", TEXT),
        StructField("shipping_methods", TEXTS),
        StructField("expedited_shipping", FLAG),
        StructField("international_shipping", FLAG),
        StructField("handling_time", TEXT),
        StructField("return_policy", TEXT),
        StructField("return_period", TEXT),
        StructField("image_count", COUNT),
        StructField("has_video", FLAG),
        StructField("video_urls", TEXTS),
        StructField("main_image_url", TEXT),
        StructField("main_image_path", TEXT),
        StructField("description_length", COUNT),
        StructField("title_quality_score", NUMBER),
        StructField("description_quality_score", NUMBER),
        StructField("image_quality_score", NUMBER),
        StructField("data_completeness_score", NUMBER),
        StructField("completeness_score", NUMBER),
        StructField("created_at", TIME),
        StructField("updated_at", TIME),
        StructField("scraped_at", TIME),
        StructField("listing_date", TIME),
        StructField("start_time", TIME),
        StructField("end_time", TIME),
        StructField("last_seen", TIME),
        StructField("is_validated", FLAG),
        StructField("validation_errors", TEXTS),
        StructField("validation_score", NUMBER),
        StructField("data_source", TEXT),
        StructField("scraper_version", TEXT),
        StructField("content_hash", TEXT),
        StructField("listing_hash", TEXT),
        StructField("metadata", PAIRS),
        StructField("raw_data", PAIRS),
        StructField("extraction_metadata", PAIRS),
        StructField("processing_flags", PAIRS),
    ]
)
IMAGES = StructType(
    [
        StructField("image_id", TEXT),
        StructField("listing_id", TEXT),
        StructField("original_url", TEXT),
        StructField("local_path", TEXT),
        StructField("filename", TEXT),
        StructField("image_type", TEXT),
        StructField("sequence_order", COUNT),
        StructField("is_primary", FLAG),
        StructField("file_size", COUNT),
        StructField("width", COUNT),
        StructField("height", COUNT),
        StructField("format", TEXT),
        StructField("color_mode", TEXT),
        StructField("bit_depth", COUNT),
        StructField("is_processed", FLAG),
        StructField("is_optimized", FLAG),
        StructField("is_resized", FLAG),
        StructField("quality_score", NUMBER),
        StructField("resolution_score", NUMBER),
        StructField("sharpness_score", NUMBER),
        StructField("brightness_score", NUMBER),
        StructField("contains_text", FLAG),
        StructField("contains_watermark", FLAG),
        StructField("contains_logo", FLAG),
        StructField("is_duplicate", FLAG),
        StructField("similarity_hash", TEXT),
        StructField("color_histogram", TEXT),
        StructField("dominant_colors", TEXTS),
        StructField("ai_tags", TEXTS),
        StructField("ai_confidence", NUMBER),
        StructField("object_detection", TEXTS),
        StructField("alt_text", TEXT),
        StructField("generated_description", TEXT),
        StructField("manual_description", TEXT),
        StructField("processing_history", TEXTS),
        StructField("optimization_settings", PAIRS),
        StructField("created_at", TIME),
        StructField("downloaded_at", TIME),
        StructField("processed_at", TIME),
        StructField("last_verified", TIME),
        StructField("download_attempts", COUNT),
        StructField("download_errors", TEXTS),
        StructField("processing_errors", TEXTS),
        StructField("metadata", PAIRS),
        StructField("exif_data", PAIRS),
    ]
)
SPECIFICATIONS = StructType(
    [
        StructField("spec_id", TEXT),
        StructField("listing_id", TEXT),
        StructField("attribute_name", TEXT),
        StructField("attribute_value", TEXT),
        StructField("attribute_category", TEXT),
        StructField("attribute_type", TEXT),
        StructField("source_section", TEXT),
        StructField("extraction_method", TEXT),
        StructField("confidence_score", NUMBER),
        StructField("standardized_name", TEXT),
        StructField("standardized_value", TEXT),
        StructField("standardized_category", TEXT),
        StructField("unit", TEXT),
        StructField("unit_standardized", TEXT),
        StructField("numeric_value", NUMBER),
        StructField("boolean_value", FLAG),
        StructField("date_value", TIME),
        StructField("is_verified", FLAG),
        StructField("is_standardized", FLAG),
        StructField("validation_status", TEXT),
        StructField("quality_score", NUMBER),
        StructField("related_specs", TEXTS),
        StructField("conflicts_with", TEXTS),
        StructField("created_at", TIME),
        StructField("updated_at", TIME),
        StructField("verified_at", TIME),
        StructField("metadata", PAIRS),
    ]
)
SESSIONS = StructType(
    [
        StructField("session_id", TEXT),
        StructField("session_name", TEXT),
        StructField("parent_session_id", TEXT),
        StructField("search_query", TEXT),
        StructField("search_filters", PAIRS),
        StructField("search_categories", TEXTS),
        StructField("max_pages", COUNT),
        StructField("max_listings", COUNT),
        StructField("target_quality_score", NUMBER),
        StructField("status", TEXT),
        StructField("progress_percentage", NUMBER),
        StructField("current_phase", TEXT),
        StructField("listings_found", COUNT),
        StructField("listings_scraped", COUNT),
        StructField("listings_failed", COUNT),
        StructField("listings_skipped", COUNT),
        StructField("listings_duplicate", COUNT),
        StructField("images_found", COUNT),
        StructField("images_downloaded", COUNT),
        StructField("images_failed", COUNT),
        StructField("images_skipped", COUNT),
        StructField("pages_processed", COUNT),
        StructField("requests_made", COUNT),
        StructField("requests_successful", COUNT),
        StructField("requests_failed", COUNT),
        StructField("data_volume_mb", NUMBER),
        StructField("average_quality_score", NUMBER),
        StructField("high_quality_count", COUNT),
        StructField("low_quality_count", COUNT),
        StructField("started_at", TIME),
        StructField("completed_at", TIME),
        StructField("paused_at", TIME),
        StructField("resumed_at", TIME),
        StructField("last_activity", TIME),
        StructField("estimated_completion", TIME),
        StructField("error_count", COUNT),
        StructField("warning_count", COUNT),
        StructField("critical_error_count", COUNT),
        StructField("last_error", TEXT),
        StructField("error_categories", PAIRS),
        StructField("retry_count", COUNT),
        StructField("performance_metrics", PAIRS),
        StructField("resource_usage", PAIRS),
        StructField("metadata", PAIRS),
        StructField("tags", TEXTS),
        StructField("notes", TEXT),
    ]
)
QUALITY_LOG = StructType(
    [
        StructField("listing_id", TEXT),
        StructField("check_type", TEXT),
        StructField("score_before", NUMBER),
        StructField("score_after", NUMBER),
        StructField("score_change", NUMBER),
        StructField("logged_at", TIME),
    ]
)
EXPORT_HISTORY = StructType(
    [
        StructField("export_id", TEXT),
        StructField("format", TEXT),
        StructField("path", TEXT),
        StructField("record_count", COUNT),
        StructField("filters", TEXT),
        StructField("status", TEXT),
        StructField("error", TEXT),
        StructField("exported_at", TIME),
    ]
)
ERRORS = StructType(
    [
        StructField("error_id", TEXT),
        StructField("timestamp", TIME),
        StructField("error_type", TEXT),
        StructField("error_message", TEXT),
        StructField("severity", TEXT),
        StructField("category", TEXT),
        StructField("operation", TEXT),
        StructField("url", TEXT),
        StructField("context", PAIRS),
        StructField("retry_count", COUNT),
        StructField("resolved", FLAG),
    ]
)
REQUESTS = StructType(
    [
        StructField("session_id", TEXT),
        StructField("operation", TEXT),
        StructField("timestamp", TIME),
        StructField("response_time", NUMBER),
        StructField("status_code", COUNT),
        StructField("success", FLAG),
        StructField("error_type", TEXT),
        StructField("detection_risk", NUMBER),
        StructField("retry_count", COUNT),
    ]
)
PAGES = StructType(
    [
        StructField("page_id", COUNT),
        StructField("url", TEXT),
        StructField("html", TEXT),
    ]
)

TABLES = {
    "listings": LISTINGS,
    "images": IMAGES,
    "specifications": SPECIFICATIONS,
    "sessions": SESSIONS,
    "quality_log": QUALITY_LOG,
    "export_history": EXPORT_HISTORY,
    "errors": ERRORS,
    "requests": REQUESTS,
    "pages": PAGES,
}
