"""Stored report results, keyed by the whole request and fresh for a limited time."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.plans.reports import ReportRequest
from bazaarlens.sources.store import append_history, read_history

LOG = "report string, key string, path string, event string, at timestamp"


class ReportCache:
    """Parquet results below ``root`` plus an append-only log of writes and hits."""

    def __init__(self, spark: SparkSession, root: str, ttl: timedelta = timedelta(hours=24)):
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl
        self.log_path = f"{self.root}/_log"

    def log(self) -> DataFrame:
        return read_history(self.spark, self.log_path, LOG)

    def _note(self, report: str, key: str, path: str | None, event: str, now: datetime) -> None:
        append_history(self.spark, self.log_path, LOG, [(report, key, path, event, now)])

    def get(
        self, report: str, request: ReportRequest, now: datetime, build: Callable[[], DataFrame]
    ) -> DataFrame:
        """The stored result while it is fresh, else the newly built and stored one."""
        key = request.key(report)
        cleared = self.log().where(F.col("event") == "clear").groupBy("report").agg(
            F.max("at").alias("cleared_at")
        )
        fresh = (
            self.log()
            .where((F.col("key") == key) & (F.col("event") == "write"))
            .where(F.col("at") > F.lit(now - self.ttl).cast("timestamp"))
            .join(cleared, "report", "left")
            .where("cleared_at IS NULL OR at > cleared_at")
            .orderBy(F.desc("at"))
            .select("path")
            .limit(1)
            .collect()
        )
        if fresh:
            self._note(report, key, fresh[0][0], "hit", now)
            return self.spark.read.parquet(fresh[0][0])
        path = f"{self.root}/{report}/{key}/{now:%Y%m%dT%H%M%S%f}"
        build().write.mode("overwrite").parquet(path)
        self._note(report, key, path, "write", now)
        return self.spark.read.parquet(path)

    def clear(self, report: str, now: datetime) -> None:
        """Later reads of this report type build anew."""
        self._note(report, None, None, "clear", now)

    def stats(self) -> DataFrame:
        """Entries and hits per report type."""
        return self.log().groupBy("report").agg(
            F.count_distinct(F.when(F.col("event") == "write", F.col("key"))).alias("entries"),
            F.count_if(F.col("event") == "hit").alias("hits"),
            F.max("at").alias("last_used"),
        )


