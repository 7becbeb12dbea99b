"""Structured Streaming jobs over request, error and page streams.

Rows later than the watermark cannot change closed windows; ``late_rows`` says how many a query
has left out. Windowed results go out in update mode:
every trigger appends its changed rows with the batch number, and readers take
the newest row per key, so a replayed batch changes nothing.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from bazaarlens.functions import errors as err
from bazaarlens.functions.scoring import MIN_INGEST_SCORE
from bazaarlens.operators.latest import latest_per_key
from bazaarlens.plans import logs
from bazaarlens.plans.ingest import ingest
from bazaarlens.session import remove
from bazaarlens.streaming.ordered import ordered_fold

WATERMARK = "10 minutes"
LOW_SCORE = "Data quality score too low"
REJECT_COLUMNS = [
    "page_id", "listing_id", "url", "title", "price", "quality_score", "scraped_at", "reasons",
]
INGEST_COUNTS = "batch_id long, pages long, accepted long, rejected long"
LATE_COUNTS = "run string, batch_id long, late_rows long"
SLOT_MS = 60_000  # rows of a session that wait together for the watermark
# Late rows by run and batch of the queries started here: Spark keeps only the newest progress.
_LATE: dict[str, dict[int, int]] = {}


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet",
    format: str = "parquet", per_trigger: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.format(format).load(folder)


def timed(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return stream.withWatermark("timestamp", watermark)


# Windowed queries ----------------------------------------------------------------------

def request_counts(log: DataFrame, size: str = "1 minute", limit: int | None = None) -> DataFrame:
    return logs.request_windows(timed(log), size, limit)


def error_rates(log: DataFrame, size="10 minutes", slide="1 minute") -> DataFrame:
    return logs.error_rate_windows(timed(log), size, slide)


def recurring_errors(log: DataFrame, minutes=60, slide=5, threshold=5) -> DataFrame:
    return logs.error_windows(logs.classified(timed(log)), minutes, slide, threshold)


def frequent_errors(log: DataFrame, per_minute: float = 2.0, minutes=60, slide=5) -> DataFrame:
    return logs.frequent_errors(recurring_errors(log, minutes, slide), per_minute)


def hourly_errors(log: DataFrame) -> DataFrame:
    return logs.hourly_errors(logs.classified(timed(log)))


def gap_sessions(log: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    grouped = timed(log).groupBy(F.session_window("timestamp", gap).alias("w"), key)
    return grouped.agg(
        F.count("*").alias("requests"), F.count_if("success").alias("succeeded")
    ).select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"),
             "requests", "succeeded")


def unseen(stream: DataFrame, key: str, watermark: str | None = WATERMARK) -> DataFrame:
    """First sighting of each key; with a watermark the state stays bounded."""
    if watermark is None:
        return stream.dropDuplicates([key])
    return timed(stream, watermark).dropDuplicatesWithinWatermark([key])


# Stateful folds --------------------------------------------------------------------------

def weighted_risk(log: DataFrame, watermark: str = WATERMARK, slot_ms: int = SLOT_MS) -> DataFrame:
    """Running ``s <- 0.8 s + 0.2 x`` per session in time order; input has a ``risk`` column."""
    return ordered_fold(timed(log, watermark), F.lit(0.8), F.col("risk") * 0.2, slot_ms=slot_ms)


def decaying_risk(log: DataFrame, watermark: str = WATERMARK, slot_ms: int = SLOT_MS) -> DataFrame:
    """Running risk in time order: times 0.95 per success, plus the failure's risk up to 1."""
    ok = F.col("success")
    return ordered_fold(
        timed(log, watermark), F.when(ok, 0.95).otherwise(1.0), F.when(ok, 0.0).otherwise(F.col("risk")),
        F.when(ok, float("inf")).otherwise(1.0), slot_ms,
    )


def with_request_risk(log: DataFrame) -> DataFrame:
    risk = F.when(F.col("success"), 0.0).otherwise(
        err.request_risk(F.col("error_message"), F.col("status_code"))
    )
    return log.withColumn("risk", risk)


# Starting queries ----------------------------------------------------------------------------

def _note(late: dict[int, int], progress) -> None:
    rows = sum(state["numRowsDroppedByWatermark"] for state in progress["stateOperators"])
    if rows:
        late[progress["batchId"]] = max(rows, late.get(progress["batchId"], 0))


def _started(
    stream: DataFrame, work: Callable[[DataFrame, int], None], mode: str, checkpoint: str
) -> StreamingQuery:
    """Run ``work`` on everything available, and keep count of late rows for ``late_rows``."""
    handle: list[StreamingQuery] = []
    ready = threading.Event()
    late: dict[int, int] = {}

    def run(batch: DataFrame, batch_id: int) -> None:
        work(batch, batch_id)
        ready.wait()  # the first batch may come before the handle
        if handle and (before := handle[0].lastProgress):  # that of the trigger before
            _note(late, before)

    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(run)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        _LATE[str(query.runId)] = late
        handle.append(query)
        return query
    finally:
        ready.set()


# Ingest ------------------------------------------------------------------------------------

def ingest_stream(pages: DataFrame, min_score: float = MIN_INGEST_SCORE) -> DataFrame:
    """Accepted listings of a page stream, every sighting; ``seen_at`` of a page is kept."""
    return ingest(pages).where(F.col("accepted") & (F.col("quality_score") >= min_score))


def start_ingest(
    pages: DataFrame, table, rejects: str, now, checkpoint: str, min_score: float = MIN_INGEST_SCORE
) -> StreamingQuery:
    """Merge the accepted listings of a page stream into ``table`` and keep the others.

    A page without title or price, one that fails the gate and one below ``min_score`` goes to
    ``rejects`` with its ``reasons``; ``rejects_of`` and ``ingest_counts`` read them. Both sides of
    a batch are written under its number, so repeating it changes nothing.
    """
    run = _run_name(checkpoint)

    def split(batch: DataFrame, batch_id: int) -> None:
        read = ingest(batch, keep_incomplete=True)
        low = F.when(F.col("quality_score") < min_score, F.lit(LOW_SCORE))
        reasons = F.array_union("gate_errors", F.array_compact(F.array(low)))
        # an observation counts both sides while they are written
        counts = Observation("ingest")
        rows = _seen(read.withColumn("reasons", reasons), now).observe(
            counts, F.count("*").alias("pages"), F.count_if(F.size("reasons") == 0).alias("accepted")
        )
        spark, path = batch.sparkSession, f"{rejects}/parsed"
        # both sides read the batch; its pages are parsed once
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
        rejected = rows.where(F.size("reasons") > 0).select(*REJECT_COLUMNS)
        rejected.write.mode("overwrite").parquet(f"{rejects}/rows/batch={run}-{batch_id:08d}")
        table.upsert(rows.where(F.size("reasons") == 0).drop("reasons"), f"{run}-{batch_id:08d}", stored=True)
        remove(spark, path)
        found = counts.get
        spark.createDataFrame(
            [(batch_id, found["pages"], found["accepted"], found["pages"] - found["accepted"])], INGEST_COUNTS
        ).coalesce(1).write.mode("overwrite").parquet(f"{rejects}/counts/batch={run}-{batch_id:08d}")

    return _started(pages, split, "append", checkpoint)


def rejects_of(spark: SparkSession, rejects: str) -> DataFrame:
    """Every rejected page with its reasons, by batch."""
    return spark.read.parquet(f"{rejects}/rows")


def ingest_counts(spark: SparkSession, rejects: str) -> DataFrame:
    """``batch_id, pages, accepted, rejected`` of every batch."""
    return spark.read.schema(INGEST_COUNTS).parquet(f"{rejects}/counts")


def _run_name(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _seen(rows: DataFrame, now) -> DataFrame:
    """Rows with the time of their sighting: the page's ``seen_at`` where it has one, else now."""
    seen = F.lit(now()).cast("timestamp")
    if "seen_at" in rows.columns:
        seen = F.coalesce(F.col("seen_at").cast("timestamp"), seen)
    return rows.withColumn("scraped_at", seen).drop("seen_at")


def start_upsert(stream: DataFrame, table, now, checkpoint: str) -> StreamingQuery:
    """Merge every micro-batch into a current-version table.

    The newest sighting of a listing wins, in a batch and against the table: by the page's
    ``seen_at`` where it has one, else by ``now()``. A batch is named in the table's change log by
    the checkpoint and its number, so repeating it changes nothing.
    """
    run = _run_name(checkpoint)

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.upsert(_seen(batch, now), f"{run}-{batch_id:08d}")

    return _started(stream, merge, "append", checkpoint)


# Running and reading updates ------------------------------------------------------------------

def start_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each trigger's changed rows below ``path`` with their batch number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id:08d}"
        )

    return _started(stream, write, "update", checkpoint)


def late_rows(query: StreamingQuery) -> int:
    """Rows (after partial aggregation) that came too late for their window, over all triggers of
    this run. Of a query that was not started here only Spark's newest progress is left; when that
    may lack triggers, this is an error."""
    progress = query.recentProgress
    late = _LATE.get(str(query.runId))
    if late is None:
        if progress and progress[0]["batchId"] > 0:
            raise ValueError("the query was not started here, and earlier triggers may be forgotten")
        late = {}
    late = dict(late)
    for own in progress:
        _note(late, own)
    return sum(late.values())


def store_late_rows(query: StreamingQuery, folder: str) -> None:
    """Write the late rows of every trigger of a finished run that had some beside its update log,
    where they outlive this process, and forget them here."""
    late_rows(query)  # an error if triggers may be missing
    late = _LATE.pop(str(query.runId), {})
    for own in query.recentProgress:
        _note(late, own)
    rows = [(str(query.runId), number, n) for number, n in sorted(late.items())]
    spark = SparkSession.active()
    spark.createDataFrame(rows, LATE_COUNTS).coalesce(1).write.mode("overwrite").parquet(
        f"{folder}/late/run={query.runId}"
    )


def stored_late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``run, batch_id, late_rows`` of all runs of a query's folder."""
    return spark.read.schema(LATE_COUNTS).parquet(f"{folder}/late/*")


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key of an update log."""
    log = spark.read.parquet(path).drop("batch")
    return latest_per_key(log, keys, ["batch_id"]).drop("batch_id")


def run_updates(
    spark: SparkSession, stream: DataFrame, folder: str, keys: list[str]
) -> DataFrame:
    """Process everything available once and return the current result."""
    query = start_updates(stream, f"{folder}/updates", f"{folder}/checkpoint")
    query.awaitTermination()
    store_late_rows(query, folder)
    return latest_updates(spark, f"{folder}/updates", keys)


def run_complete(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Process everything available once in complete mode (session windows have no update mode)
    and return the last trigger's result."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    query = _started(stream, write, "complete", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/result")
