"""Ordered per-key folds of the form ``s <- min(cap, a*s + b)``.

Such steps compose: two of them are again one ``(cap, a, b)`` step. The rows are
range-partitioned by key and time, each Arrow batch composes its own stretch per
key, and only one small row per batch and key is combined at the end. A key
with any share of the rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRETCH = "_key string, _first struct<t:bigint,i:bigint>, _n bigint, _cap double, _a double, _b double"


def composed(
    code: np.ndarray, cap: np.ndarray, a: np.ndarray, b: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One step per run of equal ``code``: the steps of the run one after the other.

    Neighbouring steps are composed pairwise in rounds, whole columns at a time, so n rows take
    log2(n) rounds whatever the runs are.
    """
    cap, a, b = cap.astype(float), a.astype(float), b.astype(float)
    while True:
        starts = np.flatnonzero(np.diff(code, prepend=code[:1] - 1))
        if len(starts) == len(code):
            return cap, a, b
        # within a run, the first of each pair takes in the second
        rank = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
        first = np.flatnonzero(rank % 2 == 0)
        paired = first[first + 1 < len(code)]
        paired = paired[code[paired + 1] == code[paired]]
        then = paired + 1
        with np.errstate(invalid="ignore"):
            moved = a[then] * cap[paired] + b[then]
        # a step without a cap has none to carry on
        moved = np.where(np.isinf(cap[paired]), np.inf, moved)
        cap[paired] = np.minimum(cap[then], moved)
        b[paired] = a[then] * b[paired] + b[then]
        a[paired] = a[then] * a[paired]
        code, cap, a, b = code[first], cap[first], a[first], b[first]


def _compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compose consecutive steps of equal key: one row per key and batch."""
    for batch in batches:
        if batch.empty:
            continue
        code = (batch["_key"] != batch["_key"].shift()).cumsum().to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=0))
        cap, a, b = composed(code, *(batch[c].to_numpy(float) for c in ("_cap", "_a", "_b")))
        heads = batch.iloc[starts]
        yield pd.DataFrame({
            "_key": heads["_key"].to_numpy(),
            "_first": heads[["_t", "_i"]].rename(columns={"_t": "t", "_i": "i"}).to_dict("records"),
            "_n": np.diff(np.append(starts, len(code))), "_cap": cap, "_a": a, "_b": b,
        })


def fold_steps(
    log: DataFrame,
    key: str,
    time: str,
    tie: str,
    a: Column,
    b: Column,
    cap: Column | None = None,
    start: float = 0.0,
    result: str = "value",
) -> DataFrame:
    """Final ``s`` of every key after its steps in time order, and the step count."""
    infinite = F.lit(float("inf"))
    steps = log.select(
        F.col(key).cast("string").alias("_key"),
        F.unix_micros(time).alias("_t"),
        F.col(tie).cast("long").alias("_i"),
        (infinite if cap is None else cap).cast("double").alias("_cap"),
        a.cast("double").alias("_a"),
        b.cast("double").alias("_b"),
    )
    order = ["_key", "_t", "_i"]
    stretches = (
        steps.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_compose, _STRETCH)
    )
    # At most one stretch per key and Arrow batch of the sorted rows reaches a group here.
    parts = stretches.groupBy("_key").agg(
        F.sum("_n").alias("steps"),
        F.sort_array(F.collect_list(F.struct("_first", "_cap", "_a", "_b"))).alias("_parts"),
    )
    folded = F.aggregate(
        "_parts",
        F.lit(float(start)),
        lambda s, p: F.least(p["_cap"], p["_a"] * s + p["_b"]),
    )
    return parts.select(F.col("_key").alias(key), "steps", folded.alias(result))


def weighted_risk(log: DataFrame, risk: Column, key="session_id", time="timestamp", tie="request_id"):
    """Exponentially weighted risk ``s <- 0.8 s + 0.2 x`` per session."""
    return fold_steps(log, key, time, tie, F.lit(0.8), risk * 0.2, result="risk")


def decaying_risk(
    log: DataFrame,
    success: Column,
    risk: Column,
    key="session_id",
    time="timestamp",
    tie="request_id",
):
    """Risk that shrinks by 5% per success and grows, capped at 1, per failure."""
    return fold_steps(
        log,
        key,
        time,
        tie,
        F.when(success, 0.95).otherwise(1.0),
        F.when(success, 0.0).otherwise(risk),
        F.when(success, float("inf")).otherwise(1.0),
        result="risk",
    )
