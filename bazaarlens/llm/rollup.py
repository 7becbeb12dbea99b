"""Token counts as additive rollups maintained by deltas.

Totals of documents, tokens and characters are kept by source, language and tokenizer version.
They change by batches of signed counts: an insert adds, a delete subtracts, a revision subtracts
the old count and adds the new one, so no document is counted again to maintain a total.

A batch has an id and is reduced to one row per key before it is written to a folder of that
name; Spark's own job marker commits it. A batch that is already committed is skipped, one that
was broken off is written anew: committing a batch twice changes nothing. Totals are the sum over
committed batches. ``compact`` folds them into a snapshot that names the batches it holds, so
that readers add only younger ones and a late repeat is still recognised.

One writer per batch id and one compactor are assumed; different batches may be committed side by
side. Sums combine
before the shuffle, so a source that holds most rows is no burden. Null keys are keys of their
own, null counts are 0, and repeated change rows count each. Keys whose totals are all 0 are left
out. Other columns of the changes are ignored.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bazaarlens.llm.bpe import Bpe
from bazaarlens.llm.common import map_texts

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["n_docs", "n_tokens", "n_chars"]
DELTA = (
    "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint, n_chars bigint"
)

# Patterns of the built-in word tokenizers, by version.
WORDS = {
    "words@1": r"[^\x20\x09-\x0D]+",
    "words@2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[!-/:-@\[-`{-~]",
}


def word_count(text: Column, tokenizer: str) -> Column:
    """Tokens of ``text`` under a built-in tokenizer; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS[tokenizer])), F.lit(0)).cast("bigint")


def bpe_counts(
    docs: DataFrame, bpe: Bpe, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, tokenizer, n_tokens`` under a rank file."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        sizes = [len(bpe.encode(text.as_py())) for text in batch.column(1)]
        names = [tokenizer] * len(sizes)
        return [batch.column(0), pa.array(names, pa.string()), pa.array(sizes, pa.int64())]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(
        docs, [id_col, text_col], f"{id_col} {kind}, tokenizer string, n_tokens bigint", work
    )


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Change rows that add (1) or subtract (-1) the counts of ``rows``."""
    return rows.select(*KEYS, F.lit(sign).alias("sign"), "n_tokens", "n_chars")


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change rows that replace the counts of ``before`` by those of ``after``."""
    return signed(before, -1).unionByName(signed(after, 1))


def _reduced(rows: DataFrame, **sums: Column) -> DataFrame:
    return rows.groupBy(*KEYS).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in sums.items()]
    )


class TokenRollup:
    """The rollup kept below ``path``, a folder that all of the cluster can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        """Folders below ``folder`` that a finished job has marked."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        names = [entry.getPath().getName() for entry in files.listStatus(root)]
        done = [n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
        return sorted(done)

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """The youngest snapshot and the batches it holds. The list of batches is written after
        the totals, so a snapshot with a list is whole."""
        whole = self._names("held")
        if not whole:
            return None, set()
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/held/{whole[-1]}")
        return whole[-1], {row["batch"] for row in held.toLocalIterator()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (KEYS, sign, n_tokens, n_chars) as ``batch``; False if it had been
        applied before."""
        if not batch or batch.strip("abcdefghijklmnopqrstuvwxyz0123456789-"):
            raise ValueError("a batch id has small letters, digits and dashes")
        if batch in self._names("batches") or batch in self._snapshot()[1]:
            return False
        sign = F.col("sign")
        delta = _reduced(
            changes, n_docs=sign, n_tokens=sign * F.coalesce("n_tokens", F.lit(0)),
            n_chars=sign * F.coalesce("n_chars", F.lit(0)),
        )
        delta.write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _sum(self) -> tuple[DataFrame, list[str]]:
        snapshot, held = self._snapshot()
        young = [name for name in self._names("batches") if name not in held]
        read = self.spark.read.schema(DELTA)
        parts = [read.parquet(f"{self.path}/batches/{name}") for name in young]
        if snapshot is not None:
            parts.append(read.parquet(f"{self.path}/totals/{snapshot}"))
        if not parts:
            parts = [self.spark.createDataFrame([], DELTA)]
        rows = reduce(DataFrame.unionByName, parts)
        return _reduced(rows, **{n: F.col(n) for n in MEASURES}), sorted(held | set(young))

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_chars`` of all committed batches."""
        return self._sum()[0].where("n_docs <> 0 OR n_tokens <> 0 OR n_chars <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot."""
        last = self._snapshot()[0]
        name = f"{int(last or 0) + 1:08d}"
        rows, held = self._sum()
        rows.write.mode("overwrite").parquet(f"{self.path}/totals/{name}")
        batches = self.spark.createDataFrame([(b,) for b in held], "batch string")
        batches.write.mode("overwrite").parquet(f"{self.path}/held/{name}")
