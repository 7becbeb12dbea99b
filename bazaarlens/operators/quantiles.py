"""Exact grouped quantiles that never sort or buffer a whole group.

Equal values of a key become one row with its count. A mergeable sketch cuts the values of each key
into slices of about equally many such rows; slices are counted, and only those that hold a wanted
rank are ranked. The sketch decides how even the slices are, never the result, and the slices of a
hot key lie in different tasks. The input is read once: its counts, and the slices, are written to
the shared folder, since both are used more than once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bazaarlens.session import written

SLICES = 64
ACCURACY = 1_000


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], slices: int = SLICES
) -> DataFrame:
    """Interpolated quantiles (``name -> fraction``) of ``value`` per key; NULL values do not
    count, a NULL key is a key."""
    rows = df.where(F.col(value).isNotNull()).select(
        F.struct(*keys).alias("_k"), F.col(value).alias("_v")
    )
    counted = written(rows.groupBy("_k", "_v").agg(F.count("*").alias("_c")), "counts")
    marks = [i / slices for i in range(1, slices)]
    sketch = written(
        counted.groupBy("_k").agg(F.percentile_approx("_v", marks, ACCURACY).alias("_marks")), "sketch"
    )
    # a table of few numbers per key: Spark broadcasts it while it is small, else splits hot keys
    placed = written(
        counted.join(sketch, "_k").select(
            "_k", "_v", "_c", F.size(F.filter("_marks", lambda m: m < F.col("_v"))).alias("_slice")
        ), "slices",
    )
    # At most ``slices`` rows per key from here on.
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_k", "_slice").agg(F.sum("_c").alias("_c")).select(
        "*", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(Window.partitionBy("_k")).alias("_n"),
    )
    ranks = F.inline(
        F.array(
            *[
                F.struct(F.lit(name).alias("_name"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("_at"))
                for name, q in wanted.items()
            ]
        )
    )
    near = (F.ceil("_at") >= F.col("_before")) & (F.floor("_at") < F.col("_before") + F.col("_c"))
    held = written(
        sizes.select("*", ranks).where(near).select("_k", "_slice", "_before", "_name", "_at"), "ranks"
    )
    needed = held.select("_k", "_slice", "_before").distinct()
    upto = Window.partitionBy("_k", "_slice").orderBy("_v")
    ranked = placed.join(needed, ["_k", "_slice"]).select(
        "_k", "_slice", "_v", "_c", (F.sum("_c").over(upto) + F.col("_before")).alias("_end")
    )
    start, end = F.col("_end") - F.col("_c"), F.col("_end")

    def at(rank):
        return F.max(F.when((start <= rank) & (rank < end), F.col("_v")))

    share = F.col("_at") - F.floor("_at")
    low, high = F.col("_lo"), F.col("_hi")
    picked = (
        ranked.join(held.drop("_before"), ["_k", "_slice"])
        .groupBy("_k", "_name", "_at")
        .agg(at(F.floor("_at")).alias("_lo"), at(F.ceil("_at")).alias("_hi"))
        .select("_k", "_name", F.when(share == 0, low).otherwise(low + (high - low) * share).alias("_q"))
    )
    return picked.groupBy("_k").agg(
        *[F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in wanted]
    ).select(*[F.col("_k")[k].alias(k) for k in keys], *wanted)
