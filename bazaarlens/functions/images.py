"""Image quality from metadata columns, row checks and the 64-bit average hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and accepted formats of an image row.
FORMATS = ["JPEG", "PNG", "WEBP", "GIF", "BMP", "TIFF"]
MODES = ["RGB", "RGBA", "L", "P"]
MIN_BYTES, MAX_BYTES = 1024, 50 * 1024 * 1024
MIN_SIDE, MAX_SIDE = 50, 8000


def resolution_score(width="width", height="height") -> Column:
    return F.least(F.lit(1.0), F.col(width) * F.col(height) / 1_000_000)


def contrast_score(stddev="gray_stddev") -> Column:
    return F.least(F.lit(1.0), F.col(stddev) / 64)


def brightness_score(mean="gray_mean") -> Column:
    return 1.0 - F.abs(F.col(mean) / 255 - 0.5) * 2


def composition_score(width="width", height="height") -> Column:
    ratio = F.try_divide(F.col(width), F.col(height))
    return F.when(ratio.between(0.8, 1.2), 1.0).when(ratio.between(0.6, 1.6), 0.8).otherwise(0.6)


def overall_score(sharpness: Column | None = None, colors: Column | None = None) -> Column:
    """Weighted image score; sharpness and color richness default to one half."""
    half = F.lit(0.5)
    return (
        resolution_score() * 0.25
        + (half if sharpness is None else sharpness) * 0.25
        + contrast_score() * 0.15
        + brightness_score() * 0.15
        + (half if colors is None else colors) * 0.10
        + composition_score() * 0.10
    )


def simple_score(width="width", height="height") -> Column:
    """Resolution and squareness with a penalty for small pictures."""
    w, h = F.col(width), F.col(height)
    aspect = clamp(1.0 - F.abs(F.try_divide(w, h) - 1.0) * 0.3)
    penalty = F.when((w < 200) | (h < 200), 0.3).otherwise(0.0)
    return clamp(resolution_score(width, height) * 0.6 + aspect * 0.4 - penalty)


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def mean_of_positive(*scores: Column) -> Column:
    """Mean of the sub-scores above zero, 0.0 when there is none."""
    kept = F.filter(F.array(*scores), lambda s: s > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda a, s: a + s)
    return F.coalesce(F.try_divide(total, F.size(kept)), F.lit(0.0))


def row_error() -> Column:
    """First failed check of an image row, NULL when all pass."""
    size, w, h = F.col("file_size"), F.col("width"), F.col("height")
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "File is empty or doesn't exist")
        .when(size < MIN_BYTES, "File too small (minimum 1KB)")
        .when(size > MAX_BYTES, "File too large (maximum 50MB)")
        .when((w < MIN_SIDE) | (h < MIN_SIDE), "Image too small (minimum 50x50 pixels)")
        .when((w > MAX_SIDE) | (h > MAX_SIDE), "Image too large (maximum 8000x8000 pixels)")
        .when(
            ~F.coalesce(F.col("format").isin(FORMATS), F.lit(False)),
            F.concat(F.lit("Unsupported format: "), F.coalesce("format", F.lit("None"))),
        )
        .when(
            ~F.coalesce(F.col("color_mode").isin(MODES), F.lit(False)),
            F.concat(F.lit("Unsupported color mode: "), F.coalesce("color_mode", F.lit("None"))),
        )
    )


def average_hash(cells: Column) -> Column:
    """64-bit hash of 64 cells: a bit is set where the cell is above the mean.

    The first cell is the highest bit.
    """
    total = F.aggregate(cells, F.lit(0.0), lambda a, x: a + x.cast("double"))
    mean = total / F.size(cells)
    return F.aggregate(
        F.transform(cells, lambda x: (x.cast("double") > mean).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
