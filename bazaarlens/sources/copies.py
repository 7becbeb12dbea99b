"""Copies of a growing folder of files as a stream: every file is copied once, whatever its times.

A chain starts with a full copy. A file stream with a checkpoint appends what has come since as
numbered batches below the chain's folder; a copy is a range of batches, so partial copies write no
row twice. Rows that are late, have equal times or none need no key list: the checkpoint knows the
files, not the times. A copy that fails leaves its batch open, and the next one writes it again.

* full: a new chain with everything there is,
* incremental: the batches after the last completed copy of the chain,
* differential: the batches after the chain's full copy.

The source folder gets new files only; a changed file would not be seen. The checkpoint keeps the
names of all files it has seen, so start a new chain from time to time.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bazaarlens.session import folders, present
from bazaarlens.sources.store import append_history, read_history, stored_bytes

STREAM_LOG = (
    "copy_id string, strategy string, `table` string, status string, chain string, "
    "first_batch long, last_batch long, row_count long, size_bytes long, created_at timestamp"
)
STRATEGIES = ("full", "incremental", "differential")


class StreamedCopies:
    """Full, incremental and differential copies of folders of files, with a history log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log_path = f"{self.root}/_history"

    def history(self) -> DataFrame:
        return read_history(self.spark, self.log_path, STREAM_LOG)

    def _completed(self, table: str) -> DataFrame:
        return self.history().where((F.col("table") == table) & (F.col("status") == "completed"))

    def _chain(self, table: str) -> tuple[str, int, int] | None:
        """The newest chain: its folder, the last batch of its full copy and of any copy."""
        done = self._completed(table)
        full = done.where("strategy = 'full'").agg(F.max_by(F.struct("chain", "last_batch"), "created_at")).first()[0]
        if full is None:
            return None
        last = done.where(F.col("chain") == full.chain).agg(F.max("last_batch")).first()[0]
        return full.chain, full.last_batch, last

    def _batches(self, chain: str) -> list[int]:
        """Numbers of the whole batches of a chain."""
        names = [n for n in folders(self.spark, chain) if n.startswith("batch=")]
        return sorted(int(n[6:]) for n in names if present(self.spark, f"{chain}/{n}/_SUCCESS"))

    def _advance(self, folder: str, schema: T.StructType, chain: str, format: str, per_batch: int | None) -> None:
        """Append every file that the chain has not seen."""
        reader = self.spark.readStream.schema(schema).format(format)
        # age is no reason to leave a file out: a late one may be old
        reader = reader.option("maxFileAge", "36500d")
        if per_batch:
            reader = reader.option("maxFilesPerTrigger", per_batch)

        def write(batch: DataFrame, number: int) -> None:
            self._put(batch, f"{chain}/batch={number:08d}", format)

        query = (
            reader.load(folder).writeStream.foreachBatch(write)
            .option("checkpointLocation", f"{chain}/_checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()

    def _put(self, batch: DataFrame, path: str, format: str) -> None:
        batch.write.mode("overwrite").format(format).save(path)

    def copy(
        self, table: str, folder: str, schema: T.StructType, strategy: str, now: datetime,
        format: str = "parquet", per_batch: int | None = None,
    ) -> str:
        """Copy what the strategy asks for and return the copy's id; a partial copy without a full
        one before it is full."""
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown copy strategy: {strategy}")
        held = None if strategy == "full" else self._chain(table)
        copy_id = f"{table}-{strategy}-{now:%Y%m%dT%H%M%S%f}"
        if held is None:
            strategy, chain, first = "full", f"{self.root}/{table}-chain-{now:%Y%m%dT%H%M%S%f}", 0
        else:
            chain, full, last = held
            first = (full if strategy == "differential" else last) + 1
        try:
            self._advance(folder, schema, chain, format, per_batch)
            upto = max(self._batches(chain), default=-1)
            rows = self._range(chain, first, upto, schema, format)
            size = sum(stored_bytes(self.spark, p) for p in self._paths(chain, first, upto))
            entry = (copy_id, strategy, table, "completed", chain, first, upto, rows.count(), size, now)
        except Exception:
            entry = (copy_id, strategy, table, "failed", chain, None, None, None, None, now)
            append_history(self.spark, self.log_path, STREAM_LOG, [entry])
            raise
        append_history(self.spark, self.log_path, STREAM_LOG, [entry])
        return copy_id

    def _paths(self, chain: str, first: int, last: int) -> list[str]:
        return [f"{chain}/batch={n:08d}" for n in self._batches(chain) if first <= n <= last]

    def _range(self, chain: str, first: int, last: int, schema: T.StructType, format: str) -> DataFrame:
        paths = self._paths(chain, first, last)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).format(format).load(paths)

    def read(self, copy_id: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
        """The rows of a completed copy."""
        entry = self.history().where((F.col("copy_id") == copy_id) & (F.col("status") == "completed")).first()
        if entry is None:
            raise ValueError(f"no completed copy {copy_id}")
        return self._range(entry.chain, entry.first_batch, entry.last_batch, schema, format)

    def restored(self, table: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
        """All rows of the newest chain: its full copy and everything copied since."""
        held = self._chain(table)
        if held is None:
            return self.spark.createDataFrame([], schema)
        return self._range(held[0], 0, held[2], schema, format)
