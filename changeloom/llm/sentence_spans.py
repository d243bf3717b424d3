"""Substring dedup on sliding sentence spans: hash every run of a few consecutive
sentences, join globally, and remove the sentences that any non-first occurrence
of a repeated span covers.

Only (document, position, 128-bit hash) is shuffled for each span. First
occurrences come from an aggregation with map-side combine; the join back is a
sort-merge join between two shuffled tables, which adaptive execution splits
where a span is hot."""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import blobs, cut, fresh, over_texts, signed, texts

#: A sentence with what ends it; all matches joined are the text. The same
#: expression is read by Python, Java and RE2.
SENTENCE = r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"
_SENTENCE = re.compile(SENTENCE.encode())


def span_keys(docs: DataFrame, run: int, min_words: int, alone: int) -> DataFrame:
    """(doc_id, tid, pos, size, h1, h2): a row for each run. pos is the piece
    where it starts, size the number of pieces up to its end (pieces without a
    word are passed over)."""

    def work(batch: pa.RecordBatch) -> dict:
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), blobs(batch), strict=True):
            if doc_id is None:
                continue
            tid = signed(xxhash.xxh64_intdigest(text, seed=42))
            worded = [(at, words) for at, piece in enumerate(_SENTENCE.findall(text.lower())) if (words := piece.split())]
            keys = [b" ".join(words) for _, words in worded]
            sums = [0, *accumulate(len(words) for _, words in worded)]
            stop, last = 0, len(worded)
            for k in range(last):
                two = k + min(run, last)
                stop = max(stop, k + 1)
                while stop < last and sums[stop] - sums[k] < (min_words if stop >= two else alone):
                    stop += 1
                if sums[stop] - sums[k] < (min_words if stop >= two else alone):
                    break
                h = xxhash.xxh3_128_intdigest(b"\n".join(keys[k:stop]))
                first, final = worded[k][0], worded[stop - 1][0]
                for column, x in zip(out, (doc_id, tid, first, final - first + 1, signed(h >> 64), signed(h & ((1 << 64) - 1))), strict=True):
                    column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return dict(zip(("doc_id", "tid", "pos", "size", "h1", "h2"), (pa.array(c, k) for c, k in zip(out, kinds, strict=True)), strict=True))

    return over_texts(docs, work, "doc_id long, tid long, pos int, size int, h1 long, h2 long")


def dedup_spans(docs: DataFrame, run: int = 2, min_words: int = 20, alone: int = 40, id_col: str = "doc_id", text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with one more column, the struct `spans` (n_sentences, n_removed,
    text): the text without sentences that a repeated run covers, except in its
    first occurrence by (doc_id, position).

    Sentences end at `.`, `!`, `?` or a line's end; they are equal if their
    words are (A-Z lower-cased). From each sentence with words goes the shortest
    run of `run` sentences or more (all of a text with fewer) that holds
    min_words words or more, or of fewer sentences that hold `alone` words, if
    the text goes on that far. Defined cases: a null or empty text has no sentences and gives
    ''; rows without doc_id lose nothing and are no occurrence; equal rows are
    one occurrence; a very long text is one slice of its own, a very long
    sentence one sentence; an empty table gives an empty one. A column of the
    input named as out_col is replaced. Other columns pass."""
    source = texts(docs, id_col, text_col)
    spans = cut(span_keys(source, run, min_words, alone), "span-keys")
    place = F.struct("doc_id", "tid", "pos")
    firsts = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("h1", "h2", "first")
    again = spans.join(cut(firsts, "first-spans"), ["h1", "h2"]).filter(place != F.col("first"))
    k, t, d, p = fresh(docs, "__k", "__t", "__drop", "__pieces")
    drops = (
        again.select("doc_id", "tid", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("size") - 1)).alias("at"))
        .groupBy("doc_id", "tid")
        .agg(F.collect_set("at").alias("drop"))
        .toDF(k, t, d)
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.withColumns({k: F.col(id_col).cast("long"), t: F.xxhash64(text)}).join(drops, [k, t], "left")
    # a column of its own: inside the lambda below, an expression would be computed for each element
    joined = joined.withColumn(p, F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)))
    pieces, drop = F.col(p), F.col(d)
    count = F.size(pieces)
    kept = F.when(
        drop.isNotNull(),
        F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), count - 1), drop), lambda i: F.get(pieces, i)), ""),
    ).otherwise(text)
    out = F.struct(count.cast("long").alias("n_sentences"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"), kept.alias("text"))
    return joined.withColumn(out_col, out).drop(k, t, d, p)
