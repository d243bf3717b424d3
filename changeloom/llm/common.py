"""Shared plumbing of the training-data operators: Arrow batch mapping, the
shared work folder, word splitting and 64-bit hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.sources.tables import cut, work_folder

__all__ = ["BLANKS", "Ids", "WordHashes", "blobs", "cut", "fresh", "mix", "ngrams", "over_texts", "read_table", "signed", "slices", "texts", "word_arrays", "work_folder"]

#: The six ASCII blanks of every contract, `[\x20\x09-\x0D]`; bytes.split() and
#: bytes.strip() without arguments use exactly this set.
BLANKS = b" \t\n\x0b\x0c\r"

#: Bytes of text handled at once by a Python worker.
SLICE_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that operators use, under fixed names, so that other
    columns of the input can have any name."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of docs has it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of text (one
    document at least), which bounds a worker's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_col))
        lengths = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        groups = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)[:-1])) // limit
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def blobs(batch: pa.RecordBatch, text_col: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null reads as empty."""
    column = batch.column(batch.schema.get_field_index(text_col))
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def over_texts(docs: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow with bounded slices. `work` gets a batch of (doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=limit):
            out = work(batch)
            if out is not None:
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return docs.mapInArrow(run, schema)


class Ids(dict):
    """word -> 0, 1, 2, ... in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word of a slice."""

    def __missing__(self, key):
        self[key] = h = xxhash.xxh3_64_intdigest(key)
        return h


def signed(x: int) -> int:
    """The same 64 bits as Spark's long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_arrays(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated 64-bit word hashes, and the start of each document in them
    (one more than documents)."""
    table = WordHashes()
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    flat = np.fromiter(map(table.__getitem__, chain.from_iterable(words)), np.uint64, int(starts[-1]))
    return flat, starts


def ngrams(flat: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside each document: (hash, document index,
    position of the first word in `flat`)."""
    size = len(flat)
    if size < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.full(size - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[k : size - n + 1 + k])
    at = np.arange(size - n + 1)
    doc = np.searchsorted(starts, at, "right") - 1
    inside = at + n <= starts[doc + 1]
    return h[inside], doc[inside], at[inside]
