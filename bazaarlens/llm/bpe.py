"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A rank file has one base64 token and its rank per line. The driver reads it once and sends its
bytes (under 1 MB) with the tasks, so executors need no copy of the file.

Long texts are cut before the library sees them, so that its regular expression and its merges
work on bounded pieces. A cut is safe where every token of the whole text ends anyway: the split
pattern never lets a match go on from a non-space character to white space, nor between an ASCII
letter and an ASCII digit, and looks ahead only within white space. Each side of such a cut gives
the same matches alone as in the whole text. A text without a safe place stays in one piece.

Decoding joins the raw bytes of the ids, so ids that split a character decode exactly.

Null and empty texts have no ids; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from bazaarlens.llm.common import map_texts

LONG_TEXT = 100_000
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(maxsize=4)
def _load(rank_file: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) }
    encoding = tiktoken.Encoding(
        "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
    )
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return encoding, tokens


def safe_pieces(text: str, limit: int = LONG_TEXT) -> Iterator[str]:
    """``text`` cut at the first safe place after every ``limit`` characters."""
    start = 0
    while len(text) - start > limit:
        cut = _SAFE.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Bpe:
    """One rank file and split pattern, usable on the driver and inside tasks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.rank_file = file.read()
        self.pattern = pattern

    def encode(self, text: str | None, limit: int = LONG_TEXT) -> np.ndarray:
        """Token ids as unsigned 32-bit integers; special tokens are ordinary text."""
        encoding, _ = _load(self.rank_file, self.pattern)
        pieces = [
            encoding.encode_to_numpy(piece, disallowed_special=())
            for piece in safe_pieces(text or "", limit)
        ]
        return np.concatenate(pieces).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        """Raw bytes of the ids; an id outside the rank file raises ``IndexError``."""
        _, tokens = _load(self.rank_file, self.pattern)
        return b"".join(map(tokens.__getitem__, np.asarray(ids, "<u4").tolist()))


def encode_documents(
    docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, ids``: the token ids of every text."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = [bpe.encode(text).astype(np.int64) for text in batch.column(1).to_pylist()]
        return [batch.column(0), pa.array(ids, pa.list_(pa.int64()))]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(docs, [id_col, text_col], f"{id_col} {kind}, ids array<bigint>", work)


def decode_documents(
    encoded: DataFrame, bpe: Bpe, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """``id_col, bytes``: raw bytes of every list of ids (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=[id_col, "bytes"]
            )

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, bytes binary")


def round_trip(
    docs: DataFrame, bpe: Bpe, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode and decode every text in one pass and return digests of both directions:
    ``id_col, n_tokens, ids_sha256, decoded_sha256``."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        counts, id_digests, byte_digests = [], [], []
        for text in batch.column(1):
            ids = bpe.encode(text.as_py())
            counts.append(len(ids))
            id_digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
            byte_digests.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [
            batch.column(0),
            pa.array(counts, pa.int64()),
            pa.array(id_digests, pa.string()),
            pa.array(byte_digests, pa.string()),
        ]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(
        docs, [id_col, text_col],
        f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string", work,
    )
