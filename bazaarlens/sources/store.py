"""Scans, history logs, current-version tables, retention and table copies."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from bazaarlens.operators.joins import present_in
from bazaarlens.operators.latest import kept_rows, latest_per_key
from bazaarlens.session import folders, move, present, release, remove
from bazaarlens.sources import schemas

COPY_LOG = (
    "copy_id string, strategy string, `table` string, status string, path string, "
    "row_count long, size_bytes long, created_at timestamp, watermark timestamp"
)
# Text formats keep microseconds; Spark's default pattern would cut them to milliseconds.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
BUCKETS = 256
FILES_PER_BUCKET = 4
CROWDED_ID = 1_000  # rows of an id that are reduced where they lie before they move
CROWDED_PLACE = 1_000_000  # the same for the rows of a part of a bucket, if it has many times its share
PACKED = {"compression": "zstd"}  # of the table's files
FEW_IDS = 100_000  # so many hashes of ids are broadcast at most
TABLE_RECORD = "aside string, batch string, buckets array<int>, id_buckets array<int>"


def scan(spark: SparkSession, name: str, path: str, format: str = "parquet") -> DataFrame:
    """Read a record table with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).format(format).load(path)


def append_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("append").option("timestampFormat", MICROS).json(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.ERRORS).json(path)


# Small append-only logs ----------------------------------------------------------

def append_history(spark: SparkSession, path: str, schema: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log table, empty before its first row."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


# Nested fields as text ------------------------------------------------------------

def serialise_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, other columns unchanged."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def parse_nested(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Turn JSON text back into the nested types of ``schema``."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    kinds = {f.name: f.dataType for f in schema.fields}
    return df.select(
        *[
            F.from_json(c, kinds[c]).alias(c) if isinstance(kinds.get(c), nested) else F.col(c)
            for c in df.columns
        ]
    )


# Current-version tables -----------------------------------------------------------

class CurrentTable:
    """A keyed table in folders of URL hash buckets, with an index by id and a log of changes.

    * ``data``: the rows by hash of their URL. ``index``: the bucket of every listing id, by hash of
      the id. A change reads and rewrites only the folders it touches in both.
    * ``changes``: per batch what was inserted, updated and deleted, with the row before and after.
      A batch that is in the log is not applied again.

    A change moves every row once: stored and incoming rows meet in the part of the bucket that their
    URL gives, and what a listing was and becomes is written from there. Only ids with rows in several
    parts, and ids and parts with very many rows, are reduced by id and URL before.

    The new content is written beside the table, folders that have no row now included, then a record
    says that it is whole, then its folders are moved to the place of the old ones. A job that fails
    before the record changes nothing; one that fails after it is finished by the next use of the
    table. One writer at a time; readers that need a fixed state take a copy.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.data, self.index = f"{self.path}/data", f"{self.path}/index"
        self.log, self._record = f"{self.path}/changes", f"{self.path}/record"

    def _stored(self, folder: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(folder)
        except AnalysisException as missing:
            if not any(c in str(missing) for c in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
                raise
            return None

    def read(self) -> DataFrame | None:
        self._finish()
        stored = self._stored(self.data)
        return None if stored is None else stored.drop("_bucket")

    def changes(self) -> DataFrame | None:
        """``batch, seq, change, listing_id, before, after`` of every batch; ``seq`` counts them."""
        self._finish()
        return self._stored(self.log)

    # ---- folders

    def _hashed(self, df: DataFrame, name: str, *keys: str) -> DataFrame:
        number = F.pmod(F.xxhash64(F.coalesce(*keys)), F.lit(self.buckets)).cast("int")
        return df.withColumn(name, number)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """Rows by hash of their URL; rows without one by hash of their id."""
        return self._hashed(df, "_bucket", "url", "listing_id")

    def _numbers(self, df: DataFrame, name: str) -> list[int]:
        """The folders that ``df`` lies in: at most ``buckets`` numbers."""
        return sorted(r[0] for r in df.select(name).distinct().collect())

    def _within(self, folder: str, name: str, numbers: list[int]) -> DataFrame | None:
        """The stored rows of some folders; the others are not read."""
        stored = self._stored(folder)
        return None if stored is None else stored.where(F.col(name).isin(numbers))

    # ---- committing

    def _finish(self) -> None:
        """Put a batch in place whose record is whole; remove what an unfinished one left."""
        if present(self.spark, f"{self._record}/_SUCCESS"):
            self._publish(self.spark.read.schema(TABLE_RECORD).json(self._record).first())
        for name in folders(self.spark, self.path):
            if name == "record" or name.startswith("aside-"):
                remove(self.spark, f"{self.path}/{name}")

    def _publish(self, record) -> None:
        """Move what a batch has written into place; what was moved before a crash is not there now."""
        aside = f"{self.path}/{record.aside}"
        for source, target in ((f"{aside}/data", self.data), (f"{aside}/index", self.index)):
            for name in folders(self.spark, source):
                if "=" in name:
                    move(self.spark, f"{source}/{name}", f"{target}/{name}")
        if present(self.spark, f"{aside}/changes"):
            move(self.spark, f"{aside}/changes", f"{self.log}/batch={record.batch}")
        remove(self.spark, self._record)
        remove(self.spark, aside)

    def _held(self, folder: str, name: str) -> set[int]:
        """The numbers of the folders ``name=...`` in ``folder``."""
        return {int(n.partition("=")[2]) for n in folders(self.spark, folder) if n.startswith(f"{name}=")}

    def _put(self, rows: DataFrame, path: str, name: str, numbers: list[int]) -> list[int]:
        """Write the rows by folder, and an empty folder for those of ``numbers`` without a row."""
        rows.write.options(**PACKED).partitionBy(name).parquet(path)
        held = self._held(path, name)
        for number in sorted(set(numbers) - held):
            rows.drop(name).limit(0).write.parquet(f"{path}/{name}={number}")
        return sorted({*held, *numbers})

    def _commit(
        self, batch: str | None, aside: str, data: DataFrame, changes: DataFrame,
        moved: DataFrame, old: list[int],
    ) -> None:
        """Put ``data`` in the place of the buckets ``old`` and its own, with its changes and the ids
        that have ``moved``."""
        whole = f"{self.path}/{aside}"
        buckets = sorted(self._held(f"{whole}/data", "_bucket")) if data is None else self._put(data, f"{whole}/data", "_bucket", old)
        logged = [n for n in folders(self.spark, self.log) if n.startswith("batch=")]
        changes.withColumn("seq", F.lit(len(logged)).cast("long")).write.options(**PACKED).parquet(f"{whole}/changes")
        ids = self._numbers(moved, "_id_bucket")
        entries = moved.where("_bucket IS NOT NULL").select("listing_id", "_bucket", "_id_bucket")
        held = self._within(self.index, "_id_bucket", ids) if ids else None
        if held is not None:
            gone = moved.where("_was IS NOT NULL").select("listing_id")
            if not gone.isEmpty():
                held = held.join(gone, "listing_id", "left_anti")
            entries = held.unionByName(entries)
        ids = self._put(self._spread(entries, "_id_bucket"), f"{whole}/index", "_id_bucket", ids)
        record = (aside, batch or f"own-{len(logged):08d}", buckets, ids)
        self.spark.createDataFrame([record], TABLE_RECORD).coalesce(1).write.json(self._record)
        self._finish()

    def _spread(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of a folder in a few tasks, so that it gets a few files."""
        return rows.repartition(name, F.pmod(F.xxhash64("listing_id"), F.lit(FILES_PER_BUCKET)))

    def _kept(self, rows: DataFrame, path: str) -> DataFrame:
        """``rows`` written to ``path`` and read back."""
        rows.write.options(**PACKED).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _moved(self, changes: DataFrame) -> DataFrame:
        """``listing_id, _was, _bucket, _id_bucket`` of ids whose bucket changes; null: none."""
        ids = changes.where("listing_id IS NOT NULL AND NOT (_was <=> _bucket)")
        return self._hashed(ids.select("listing_id", "_was", "_bucket"), "_id_bucket", "listing_id")

    # ---- deciding what stays

    def _place(self):
        """The part of its bucket that a row lies in; the bucket is its remainder by ``buckets``."""
        return F.pmod(F.xxhash64(F.coalesce("url", "listing_id")), F.lit(self.buckets * FILES_PER_BUCKET)).cast("int")

    def _places(self, incoming: DataFrame) -> tuple[dict[int, int], set[int]]:
        """Rows of each place, and the index folders of the named ids."""
        new = self._hashed(incoming, "_id_bucket", "listing_id").withColumn("_place", self._place())
        named = F.when(F.col("listing_id").isNotNull(), F.col("_id_bucket"))
        found = new.groupBy("_place").agg(F.count("*").alias("n"), F.collect_set(named).alias("ids")).collect()
        return {r["_place"]: r["n"] for r in found}, {i for r in found for i in r["ids"]}

    def _gathered(self, both: DataFrame, sizes: dict[int, int], whole: str) -> tuple[DataFrame, DataFrame | None]:
        """All rows that may stay with ``_place`` and ``_far``, and the stored rows that are far.

        Far are ids with rows in several places, crowded ids and those of crowded places; they come
        reduced by id and url. Rows of any other id lie in one place, stored ones included.
        """
        rows = both.withColumn("_place", self._place())
        code = F.xxhash64("listing_id")
        seen = rows.groupBy(code.alias("_code")).agg(
            F.min("_place").alias("low"), F.max("_place").alias("high"), F.count("*").alias("n"))
        nameless = F.col("_code") == F.xxhash64(F.lit(None).cast("string"))
        apart = (F.col("low") != F.col("high")) | (F.col("n") > CROWDED_ID) | nameless
        far = self._kept(seen.where(apart).select("_code"), f"{whole}/far")
        share = max(CROWDED_PLACE, 4 * sum(sizes.values()) // (self.buckets * FILES_PER_BUCKET))
        crowded = [place for place, n in sizes.items() if n > share]
        n = far.count()
        if not n and not crowded:
            return rows.withColumn("_far", F.lit(False)), None
        far = far.withColumn("_far", F.lit(True))
        marked = rows.withColumn("_code", code).join(F.broadcast(far) if n <= FEW_IDS else far, "_code", "left").drop("_code")
        if crowded:
            # an id is far as a whole: the others lie in one place
            marked = marked.withColumn("_far", F.coalesce("_far", F.col("_place").isin(crowded)))
        marked = marked.withColumn("_far", F.coalesce("_far", F.lit(False)))
        reduced = kept_rows(marked.where("_far"))
        return marked.where("NOT _far").unionByName(reduced), marked.where("_far AND _new = 0")

    def _resolved(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """One row per id that is there before or after: ``listing_id, change, before, after, _bucket,
        _far``. An id that keeps its stored row has no ``change``, and ``before`` is filled only where
        it has one. Of far ids only ``after`` holds."""
        placed = rows.repartition("_place")
        newest = Window.partitionBy("_place", "listing_id").orderBy(
            F.desc_nulls_last("scraped_at"), F.desc_nulls_last("_new"))
        own = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        row = F.struct(*columns)
        stored = F.first(F.when(F.col("_new") == 0, row), ignorenulls=True).over(own)
        by_id = placed.withColumns({"_rank": F.row_number().over(newest), "_stored": stored}).where("_rank = 1")
        rival = Window.partitionBy("_place", "url").orderBy(
            F.desc_nulls_last("scraped_at"), F.desc_nulls_last("_new"), F.desc_nulls_last("listing_id"))
        lost = F.col("url").isNotNull() & (F.row_number().over(rival) > 1)
        out = by_id.withColumn("_lost", lost).withColumn("after", F.when(~F.col("_lost"), row))
        # as text, since maps do not compare
        same = (F.col("_new") == 0) | F.to_json("_stored").eqNullSafe(F.to_json("after"))
        change = (
            F.when(F.col("_lost"), F.when(F.col("_stored").isNotNull(), "delete"))
            .when(F.col("_stored").isNull(), "insert")
            .when(~same, "update")
        )
        out = out.withColumn("change", change).where("change IS NOT NULL OR NOT _lost")
        return out.select(
            "listing_id", "change", F.when(F.col("change").isNotNull(), F.col("_stored")).alias("before"), "after",
            F.pmod("_place", F.lit(self.buckets)).alias("_bucket"), "_far")

    # ---- changes

    def applied(self, batch: str) -> bool:
        return present(self.spark, f"{self.log}/batch={batch}/_SUCCESS")

    def upsert(self, incoming: DataFrame, batch: str | None = None, stored: bool = False) -> None:
        """Insert or replace on listing id and url, the latest row winning.

        ``batch`` names the change in the log; a name that is already there is left alone. The
        incoming rows are written once before they are used, unless they are ``stored`` already.
        """
        self._finish()
        if batch is not None and self.applied(batch):
            return
        aside = f"aside-{uuid.uuid4().hex[:12]}"
        whole = f"{self.path}/{aside}"
        if not stored:
            incoming = self._kept(incoming, f"{whole}/incoming")
        held, new = self._stored(self.data), incoming.withColumn("_new", F.lit(1))
        places = self._places(incoming)
        if held is None:
            rows, _ = self._gathered(new, places[0], whole)
            rows = latest_per_key(rows.repartition("_place"), ["_place", "listing_id"], ["scraped_at", "_new"])
            rows = rows.withColumn("_own", F.when(F.col("url").isNull(), F.col("listing_id")))
            rows = latest_per_key(rows, ["_place", "url", "_own"], ["scraped_at", "_new", "listing_id"])
            bucket = F.pmod("_place", F.lit(self.buckets)).alias("_bucket")
            after = rows.select(*incoming.columns, bucket)
            # the rows are written first: the log and the index read them there
            self._put(after, f"{whole}/data", "_bucket", [])
            remove(self.spark, f"{whole}/incoming")
            release(self.spark)
            after = self.spark.read.schema(after.schema).parquet(f"{whole}/data")
            moved = self._moved(after.withColumn("_was", F.lit(None).cast("int")))
            self._commit(batch, aside, None, changed_rows(None, after.drop("_bucket")), moved, [])
            return
        touched = self._touched(incoming, places)
        part = self._within(self.data, "_bucket", touched)
        both = part.drop("_bucket").withColumn("_new", F.lit(0)).unionByName(new, allowMissingColumns=True)
        columns = [c for c in both.columns if c != "_new"]
        rows, far = self._gathered(both, places[0], whole)
        seen = self._kept(self._resolved(rows, columns), f"{whole}/resolved")
        if far is None:  # else its rows are read again
            remove(self.spark, f"{whole}/incoming")
        release(self.spark)
        data = seen.where("after IS NOT NULL").select("after.*", "_bucket")
        near = seen.where("NOT _far AND change IS NOT NULL")
        changes = near.select("change", "listing_id", "before", "after")
        was, now = (F.when(F.col("change") != kind, F.col("_bucket")) for kind in ("insert", "delete"))
        moved = self._moved(near.select("listing_id", was.alias("_was"), now.alias("_bucket")))
        if far is not None:
            after = seen.where("_far AND after IS NOT NULL").select("after.*", "_bucket")
            changes = changes.unionByName(changed_rows(far.select(*columns), after.drop("_bucket")))
            old = far.select("listing_id", F.pmod("_place", F.lit(self.buckets)).alias("_was"))
            both = old.where("listing_id IS NOT NULL").join(
                after.select("listing_id", "_bucket").where("listing_id IS NOT NULL"), "listing_id", "full")
            moved = self._kept(moved.unionByName(self._moved(both)), f"{whole}/moved")
        self._commit(batch, aside, data, changes, moved, self._numbers(part, "_bucket"))

    def _touched(self, incoming: DataFrame, places: tuple[dict[int, int], set[int]] | None = None) -> list[int]:
        """Buckets of the incoming urls, and those where an incoming id lies now."""
        sizes, id_buckets = places or self._places(incoming)
        buckets = {place % self.buckets for place in sizes}
        if len(buckets) == self.buckets:  # no id can add one
            return sorted(buckets)
        held = self._within(self.index, "_id_bucket", sorted(id_buckets))
        if held is not None:
            ids = incoming.select("listing_id").where("listing_id IS NOT NULL").distinct()
            buckets |= set(self._numbers(held.join(ids, "listing_id", "left_semi"), "_bucket"))
        return sorted(buckets)

    def delete(self, condition, batch: str | None = None) -> None:
        """Drop the rows the condition is true for; NULL keeps the row."""
        self._finish()
        stored = self._stored(self.data)
        if stored is None or batch is not None and self.applied(batch):
            return
        doomed = F.coalesce(condition, F.lit(False))
        touched = self._numbers(stored.where(doomed), "_bucket")
        if touched:
            part = self._within(self.data, "_bucket", touched)
            # rows stay in their folders, and every dropped row is a change
            gone = part.where(doomed)
            row = F.struct(*[c for c in part.columns if c != "_bucket"])
            none = F.lit(None).cast(gone.select(row.alias("before")).schema[0].dataType)
            changes = gone.select(F.lit("delete").alias("change"), "listing_id", row.alias("before"), none.alias("after"))
            moved = self._moved(gone.select(
                "listing_id", F.col("_bucket").alias("_was"), F.lit(None).cast("int").alias("_bucket")))
            self._commit(batch, f"aside-{uuid.uuid4().hex[:12]}", part.where(~doomed), changes, moved, touched)


def changed_rows(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """``change, listing_id, before, after`` of the rows that two states do not share; None: no row
    was there, and each is an insert."""
    def state(df: DataFrame, name: str) -> DataFrame:
        held = [F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in after.dtypes]
        return df.select(F.col("listing_id").alias(f"_{name}"), F.struct(*held).alias(name))

    if before is None:
        new = state(after, "after")
        none = F.lit(None).cast(new.schema["after"].dataType).alias("before")
        return new.select(F.lit("insert").alias("change"), F.col("_after").alias("listing_id"), none, "after")
    both = state(before, "before").join(
        state(after, "after"), F.col("_before").eqNullSafe(F.col("_after")), "full"
    )
    change = (
        F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").otherwise("update")
    )
    # as text, since maps do not compare
    same = F.to_json("before").eqNullSafe(F.to_json("after"))
    return both.where(~same).select(
        change.alias("change"), F.coalesce("_after", "_before").alias("listing_id"), "before", "after"
    )


def replayed(changes: DataFrame, upto: int | None = None) -> DataFrame:
    """The table as its log says it was after batch ``upto`` (None: now)."""
    seen = changes if upto is None else changes.where(F.col("seq") <= upto)
    last = latest_per_key(seen, ["listing_id"], ["seq"])
    return last.where("change <> 'delete'").select("after.*")


def price_changes(changes: DataFrame) -> DataFrame:
    """Every price a listing has had, in the order of the log, with its change and drop."""
    seen = changes.where("change <> 'delete' AND NOT (before.price <=> after.price)")
    change = F.col("after.price") - F.col("before.price")
    return seen.select(
        "listing_id", "seq", F.col("after.scraped_at").alias("scraped_at"),
        F.col("after.price").alias("price"), F.col("before.price").alias("prev_price"),
        change.alias("price_change"),
        F.when(F.col("before.price") > 0, -change * 100.0 / F.col("before.price")).alias("drop_percentage"),
    )


# Retention --------------------------------------------------------------------------

def expired_unvalidated(as_of: datetime, days: int = 30):
    """Older than the bar and not validated."""
    return older_than(as_of, days) & ~F.col("is_validated")


def older_than(as_of: datetime, days: int, category: str | None = None):
    """Age-only retention, optionally for one category."""
    old = F.col("scraped_at") < F.lit(as_of - timedelta(days=days)).cast("timestamp")
    return old if category is None else old & (F.col("category") == category)


def retention_preview(
    listings: DataFrame, images: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    """How many listings and child images a clean-up would delete."""
    doomed = listings.where(expired_unvalidated(as_of, days))
    children = images
    if "created_at" in images.columns:
        limit = F.lit(as_of - timedelta(days=days)).cast("timestamp")
        children = images.where(F.col("created_at") < limit)
    child_rows = present_in(children, doomed, "listing_id").agg(F.count("*").alias("c")).scalar()
    return doomed.agg(F.count("*").alias("listings_to_delete")).withColumn(
        "images_to_delete", child_rows
    )


def retained(listings: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    return listings.where(~F.coalesce(expired_unvalidated(as_of, days), F.lit(False)))


def retained_images(
    images: DataFrame, listings: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    """Images without those of deleted listings; images that had no listing stay."""
    deleted = listings.where(expired_unvalidated(as_of, days)).select("listing_id").distinct()
    return images.join(deleted, "listing_id", "left_anti")


# Copies -----------------------------------------------------------------------------

class TableCopies:
    """Full, incremental and differential copies of tables with a history log."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.log_path = f"{self.root}/_history"

    def history(self) -> DataFrame:
        return read_history(self.spark, self.log_path, COPY_LOG)

    def _watermark(self, table: str, full_only: bool) -> datetime | None:
        done = self.history().where((F.col("table") == table) & (F.col("status") == "completed"))
        if full_only:
            done = done.where(F.col("strategy") == "full")
        return done.agg(F.max("watermark")).collect()[0][0]

    def _since(self, table: str, full_only: bool) -> list[str]:
        """Paths of the completed copies that a partial copy builds on, from the last full one."""
        done = self.history().where((F.col("table") == table) & (F.col("status") == "completed"))
        last = done.where(F.col("strategy") == "full").agg(F.max("created_at")).first()[0]
        kept = done.where(F.col("created_at") >= F.lit(last)) if last is not None else done
        if full_only:
            kept = kept.where(F.col("strategy") == "full")
        return [r["path"] for r in kept.select("path").toLocalIterator()]

    def copy(
        self, name: str, df: DataFrame, time: str, strategy: str, now: datetime,
        format: str = "parquet", keys: list[str] | None = None,
    ) -> str:
        """Copy the rows the strategy asks for and note the new watermark.

        Incremental starts after the last completed copy, differential after the
        last full copy; both fall back to everything on the first run. With ``keys``, rows at or
        below the watermark or without a time are copied too unless an earlier copy has their
        keys; without, the source must only grow in time order.
        """
        if strategy not in ("full", "incremental", "differential"):
            raise ValueError(f"unknown copy strategy: {strategy}")
        since = None
        if strategy != "full":
            since = self._watermark(name, full_only=strategy == "differential")
        rows = newer_than(df, time, since)
        if since is not None and keys:
            paths = self._since(name, full_only=strategy == "differential")
            held = self.spark.read.schema(df.select(*keys).schema).format(format).load(paths)
            late = df.where(~F.coalesce(F.col(time) > F.lit(since).cast("timestamp"), F.lit(False)))
            rows = rows.unionByName(late.join(held.distinct(), keys, "left_anti"))
        copy_id = f"{name}-{strategy}-{now:%Y%m%dT%H%M%S%f}"
        path = f"{self.root}/{copy_id}"
        try:
            rows.write.mode("overwrite").format(format).save(path)
            written = self.spark.read.schema(rows.schema).format(format).load(path)
            count, upto = written.agg(F.count("*"), F.max(F.col(time).cast("timestamp"))).first()
            size = stored_bytes(self.spark, path)
            entry = (copy_id, strategy, name, "completed", path, count, size, now, upto or since)
        except Exception:
            entry = (copy_id, strategy, name, "failed", path, None, None, now, None)
            append_history(self.spark, self.log_path, COPY_LOG, [entry])
            raise
        append_history(self.spark, self.log_path, COPY_LOG, [entry])
        return path

    def copy_all(self, tables: dict[str, DataFrame], times: dict[str, str], now: datetime,
                 format: str = "parquet") -> list[str]:
        return [self.copy(n, df, times[n], "full", now, format) for n, df in tables.items()]


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the data files below ``path``; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def newer_than(df: DataFrame, time: str, watermark: datetime | None) -> DataFrame:
    """Rows after the watermark; all rows without one."""
    if watermark is None:
        return df
    return df.where(F.col(time) > F.lit(watermark).cast("timestamp"))


def copy_stats(history: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return history.agg(
        F.count("*").alias("total_copies"),
        F.count_if(done).alias("completed_copies"),
        F.count_if(F.col("status") == "failed").alias("failed_copies"),
        F.count_if(F.col("status") == "running").alias("active_copies"),
        (F.coalesce(F.sum(F.when(done, F.col("size_bytes"))), F.lit(0)) / (1024 * 1024)).alias("total_size_mb"),
        F.max(F.when(done, F.col("created_at"))).alias("latest_copy"),
        F.coalesce(
            F.try_divide(F.count_if(done) * F.lit(100.0), F.count("*")), F.lit(0.0)
        ).alias("success_rate"),
    )


def list_copies(
    history: DataFrame, strategy: str | None = None, status: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Copies newest first, optionally filtered and cut."""
    out = history
    if strategy:
        out = out.where(F.col("strategy") == strategy)
    if status:
        out = out.where(F.col("status") == status)
    out = out.orderBy(F.desc("created_at"), "copy_id")
    return out if limit is None else out.limit(limit)
