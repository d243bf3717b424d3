"""Line dedup: explode normalised lines, hash, count distinct documents for each
hash, drop the lines over the threshold, reassemble by position.

A worker reduces each line to (position, 128-bit hash); the texts themselves are
not shuffled until the last join. Holders of a line are counted by min/max (or a
distinct count) with map-side partial aggregation, so a line that a third of all
documents share costs one row a task. The join of lines to the dropped hashes is
a plain sort-merge join, which adaptive execution splits where a hash is hot."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import blobs, cut, fresh, over_texts, signed, texts


def line_keys(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, tid, pos, h1, h2): a row for each line whose key has min_chars
    code points or more. tid is a hash of the text, which tells rows with equal
    doc_id apart."""

    def work(batch: pa.RecordBatch) -> dict:
        ids, out = batch.column(0).to_pylist(), ([], [], [], [], [])
        for doc_id, text in zip(ids, blobs(batch), strict=True):
            if doc_id is None:
                continue
            tid = signed(xxhash.xxh64_intdigest(text, seed=42))  # as Spark's xxhash64
            for pos, line in enumerate(text.lower().split(b"\n")):
                key = line.strip()
                if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
                    h = xxhash.xxh3_128_intdigest(key)
                    for column, x in zip(out, (doc_id, tid, pos, (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)), strict=True):
                        column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return dict(zip(("doc_id", "tid", "pos", "h1", "h2"), (pa.array(c, k) for c, k in zip(out, kinds, strict=True)), strict=True))

    return over_texts(docs, work, "doc_id long, tid long, pos int, h1 long, h2 long")


def dropped_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(doc_id, tid, drop): the positions to drop, for documents that lose any."""
    lines = line_keys(docs, min_chars)
    if min_docs == 2:  # two documents hold it exactly if the smallest holder is not the largest
        shared = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    else:
        held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        shared = held.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("one").alias("n")).filter(F.col("n") >= min_docs)
    # written first, so that the join's inputs are plain exchanges that can be split where a line is hot
    hits = lines.join(cut(shared.select("h1", "h2", "first"), "shared-lines"), ["h1", "h2"]).filter("doc_id <> first")
    return hits.groupBy("doc_id", "tid").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", out_col: str = "lines") -> DataFrame:
    """docs with one more column, the struct `lines` (n_lines, n_dropped, text):
    the text without lines that min_docs documents or more share, kept only in
    the smallest doc_id.

    A key is the line stripped of `[\\x20\\x09-\\x0D]`, with A-Z in lower case.
    Defined cases: a null or empty text is one empty line and stays; keys under
    min_chars code points always stay; a line repeated in one document only
    stays, each time; rows with equal doc_id are one holder; rows without doc_id
    lose nothing and do not count as holders; an empty table gives an empty one.
    A very long text is one slice of its own. A column of the input named as
    out_col is replaced. Other columns pass."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    k, t, d, p = fresh(docs, "__k", "__t", "__drop", "__parts")
    drops = dropped_lines(texts(docs, id_col, text_col), min_chars, min_docs).toDF(k, t, d)
    joined = docs.withColumns({k: F.col(id_col).cast("long"), t: F.xxhash64(text)}).join(drops, [k, t], "left")
    # a column of its own: inside the lambda below, an expression would be computed for each element
    joined = joined.withColumn(p, F.split(text, "\n", -1))
    parts, drop = F.col(p), F.col(d)
    kept = F.when(
        drop.isNotNull(),
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop), lambda i: F.get(parts, i)), "\n"),
    ).otherwise(text)
    lines = F.struct(
        F.size(parts).cast("long").alias("n_lines"),
        F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("text"),
    )
    return joined.withColumn(out_col, lines).drop(k, t, d, p)
