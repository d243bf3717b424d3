"""Suffix-array substring dedup: remove every byte that a repeated `width`-byte
string covers, within documents and across them.

Sorting all suffixes would shuffle `width` bytes for each byte of input. Only
suffixes that can have a partner are sorted. Window starts (suffixes cut at
`width` bytes) come in runs that share a content-defined anchor (anchors.py);
equal windows have equal anchors, so:

1. anchors are counted over the whole corpus; runs at an anchor seen once are
   done;
2. runs of equal bytes at an anchor repeat as a whole and are done as well: the
   aggregation is map-side combined, so copies cost a row for each task;
3. what is left are different runs at one anchor, at the edges of copies. Their
   bytes are range-partitioned by the leading tokens at the anchor with sampled
   splitters, and each bucket sorts its suffixes by multikey quicksort, eight
   bytes a step; neighbours equal to the full width are repeats. An anchor with
   more than `bucket` different runs is dealt over several buckets;
4. suffixes of such anchors without a partner in their own bucket are compared
   across bucket boundaries by 128-bit fingerprints: first the bytes that all
   suffixes of a cell (eight neighbouring starts) share, then, in cells met
   elsewhere, the suffixes themselves.

Texts move twice: once to meet their runs, once (copies' holders only) to meet
their spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.anchors import PART, rolling, runs
from changeloom.llm.common import blobs, cut, over_texts, signed, texts

#: Different runs of one anchor that one bucket sorts; starts in a cell.
BUCKET, CELL = 768, 8
_SECOND = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _joined(raw: list[bytes]) -> tuple[bytes, np.ndarray]:
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(t) for t in raw], out=starts[1:])
    return b"".join(raw), starts


def _anchors(docs: DataFrame, width: int) -> DataFrame:
    """(anchor): a row for each run."""

    def work(batch: pa.RecordBatch) -> dict:
        data, starts = _joined(blobs(batch))
        return {"anchor": pa.array(runs(np.frombuffer(data, np.uint8), starts, width)[3].view(np.int64))}

    return over_texts(docs.select("doc_id", "text"), work, "anchor long", limit=1 << 20)


def _runs(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, tid, start, size, anchor, content): a row for each run; content
    is a hash of all its bytes."""

    def work(batch: pa.RecordBatch) -> dict:
        raw = blobs(batch)
        data, starts = _joined(raw)
        first, size, _, anchor = runs(np.frombuffer(data, np.uint8), starts, width)
        doc = np.searchsorted(starts, first, "right") - 1
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tids = np.array([signed(xxhash.xxh64_intdigest(t, seed=42)) for t in raw], np.int64)
        content = [signed(xxhash.xxh3_64_intdigest(data[a:b])) for a, b in zip(first.tolist(), (first + size + width - 1).tolist(), strict=True)]
        return {
            "doc_id": pa.array(ids[doc]),
            "tid": pa.array(tids[doc]),
            "start": pa.array((first - starts[doc]).astype(np.int32)),
            "size": pa.array(size.astype(np.int32)),
            "anchor": pa.array(anchor.view(np.int64)),
            "content": pa.array(content, pa.int64()),
        }

    return over_texts(docs, work, "doc_id long, tid long, start int, size int, anchor long, content long", limit=1 << 20)


def repeated_suffixes(buffer: bytes, at: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which suffixes buffer[at:at+width] have an equal one in their group:
    multikey quicksort by tokens of eight bytes, vectorised. After each token,
    suffixes that stand alone in their part are out."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    data = np.frombuffer(buffer + bytes(8), np.uint8)
    token_at = np.lib.stride_tricks.sliding_window_view(data, 8)
    live, part = np.arange(len(at)), group
    for k in range(0, width, 8):
        chunk = token_at[at[live] + k]
        if width - k < 8:
            chunk = chunk.copy()
            chunk[:, width - k :] = 0
        token = np.ascontiguousarray(chunk).view(">u8").ravel()
        order = np.lexsort((token, part))
        p, t = part[order], token[order]
        new = np.concatenate(([True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])))
        number = np.cumsum(new) - 1
        tied = np.bincount(number)[number] > 1
        live, part = live[order][tied], number[tied]
        if not len(live):
            return out
    out[live] = True
    return out


def _open_runs(work: DataFrame, width: int, bucket: int) -> DataFrame:
    """The bytes of the runs to be sorted, with the leading token at the anchor
    and a bucket number where an anchor has many runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in range(10))
            for doc_id, tid, text, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                for r in own:
                    if r["send"]:
                        part = raw[r["start"] : r["start"] + r["size"] + width - 1]
                        places = rolling(np.frombuffer(part, np.uint8), PART).view(np.int64)
                        lead = int(np.flatnonzero(places == r["anchor"])[0])
                        buckets = -(-r["n_runs"] // bucket)
                        row = (signed(int.from_bytes(part[lead : lead + 8], "big")), r["anchor"], (r["content"] >> 7) % buckets, buckets > 1, doc_id, tid, r["start"], r["known"], part, lead)
                        for column, x in zip(out, row, strict=True):
                            column.append(x)
            names = ("lead", "anchor", "bucket", "shared", "doc_id", "tid", "start", "known", "bytes", "place")
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], list(names))

    return work.select("doc_id", "tid", "text", "runs").mapInArrow(run, "lead long, anchor long, bucket int, shared boolean, doc_id long, tid long, start int, known boolean, bytes binary, place int")


WINDOWS = pa.list_(pa.struct([("a", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())]))


def _sorted_buckets(opened: DataFrame, width: int) -> DataFrame:
    """(doc_id, tid, a, b, g1, g2, windows): windows a..b-1 repeat; or, with a
    cell's fingerprint g1, g2, its windows await a partner in another bucket of
    their anchor (doc_id null: they need no answer themselves)."""
    parts = opened.repartitionByRange("lead", "anchor", "bucket").sortWithinPartitions("lead", "anchor", "bucket")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        data = b"".join(r[8] for r in rows)
        raw = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(r[8]) for r in rows])
        starts = np.concatenate(([0], ends[:-1]))
        sizes = ends - starts - width + 1
        own = np.repeat(np.arange(len(rows)), sizes)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = starts[own] + inner
        groups: dict = {}
        group = np.array([groups.setdefault(r[:3], len(groups)) for r in rows], np.int64)[own]
        found = repeated_suffixes(data, at, group, width)
        column = lambda k, kind: np.array([r[k] for r in rows], kind)
        shared, doc, tid, first, known, place = (column(k, t) for k, t in ((3, bool), (4, np.int64), (5, np.int64), (6, np.int64), (7, bool), (9, np.int64)))
        # Repeats of runs that aren't known to repeat as a whole, as ranges of starts.
        hit = np.flatnonzero(found & ~known[own])
        new = np.concatenate(([True], (own[hit][1:] != own[hit][:-1]) | (hit[1:] != hit[:-1] + 1))) if len(hit) else np.zeros(0, bool)
        head = hit[new]
        a = first[own[head]] + inner[head]
        b = a + np.diff(np.concatenate((np.flatnonzero(new), [len(hit)])))
        out = [(int(doc[o]), int(tid[o]), int(x), int(y), None, None, None) for o, x, y in zip(own[head], a, b, strict=True)]
        # Windows without a partner here, and one of each that has one, by cells. Batches
        # without the former tell the latter too: the partner may wait in another batch.
        ask = np.flatnonzero(shared[own] & ~found & ~known[own])
        say = np.flatnonzero(shared[own] & (found | known[own]))
        if len(ask) or len(say):
            full = (rolling(raw, width).view(np.int64), rolling(raw, width, _SECOND).view(np.int64))
            core = (rolling(raw, width - CELL + 1).view(np.int64), rolling(raw, width - CELL + 1, _SECOND).view(np.int64))
            _, one = np.unique(np.stack((full[0][at[say]], full[1][at[say]]), 1), axis=0, return_index=True)
            cells: dict[tuple, list] = {}
            for mine, some in ((True, ask), (False, say[one])):
                cell = (place[own[some]] - inner[some]) // CELL
                spot = starts[own[some]] + place[own[some]] - CELL * cell  # where the cell's common bytes start
                for o, x, p, q in zip(own[some].tolist(), inner[some].tolist(), at[some].tolist(), spot.tolist(), strict=True):
                    key = (o if mine else None, int(core[0][q]), int(core[1][q]))
                    cells.setdefault(key, []).append({"a": int(first[o]) + x, "f1": int(full[0][p]), "f2": int(full[1][p])})
            out += [(None if o is None else int(doc[o]), None if o is None else int(tid[o]), None, None, g1, g2, windows) for (o, g1, g2), windows in cells.items()]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), WINDOWS)
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "tid", "a", "b", "g1", "g2", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= 1000 and row[:3] != held[-1][:3]:  # between groups, which hold about `bucket` rows
                    yield solve(held)
                    held = []
                held.append(row)
        if held:
            yield solve(held)

    return parts.mapInArrow(run, "doc_id long, tid long, a int, b int, g1 long, g2 long, windows array<struct<a:int,f1:long,f2:long>>")


def dedup_substrings(docs: DataFrame, width: int = 200, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256, spans (array of start, end in bytes).

    A byte goes if a string of `width` bytes that covers it also starts anywhere
    else, in the same document (overlapping or not) or another. Defined cases:
    null and empty texts and those under `width` bytes lose nothing; equal rows
    are copies and lose all; rows without doc_id lose nothing and don't count;
    an empty table gives an empty one."""
    if width < PART + 2:
        raise ValueError(f"width must be {PART + 2} or more")
    source = texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    long = source.filter((F.octet_length("text") >= width) & F.col("doc_id").isNotNull())
    shared = cut(_anchors(long, width).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    candidates = cut(_runs(long, width).join(shared, "anchor"), "candidate-runs")
    place = F.struct("doc_id", "tid", "start")
    contents = cut(candidates.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("where")), "contents")
    many = cut(contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_runs")), "runs-by-anchor")
    contents = cut(contents.join(many, "anchor").filter("n > 1 OR n_runs > 1"), "repeating")
    placed = candidates.join(contents, ["anchor", "content"])
    sent = (F.col("n_runs") > 1) & ((F.col("n") == 1) | (place == F.col("where")))
    own = placed.groupBy("doc_id", "tid").agg(
        F.collect_list(F.struct("start", "size", "anchor", "content", F.col("n_runs").cast("int").alias("n_runs"), (F.col("n") > 1).alias("known"), sent.alias("send"))).alias("runs")
    )
    tid = F.xxhash64("text")
    met = source.withColumn("tid", tid).join(own, ["doc_id", "tid"], "left")
    with_runs = F.col("runs").isNotNull()
    met = cut(
        met.select(
            "doc_id",
            "tid",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.when(~with_runs, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
            F.when(with_runs, F.col("text")).alias("text"),
            "runs",
        ),
        "documents-and-runs",
    )
    holders = met.filter("runs IS NOT NULL")
    opened = cut(_open_runs(holders, width, bucket), "open-runs")
    found = cut(_sorted_buckets(opened, width), "sorted")
    cells = found.filter("g1 IS NOT NULL")
    met_cells = cut(cells.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("g1", "g2"), "met-cells")
    alive = cut(cells.join(met_cells, ["g1", "g2"]).select("doc_id", "tid", F.inline("windows")), "windows")
    across = cut(alive.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("f1", "f2"), "across")
    late = alive.filter("doc_id IS NOT NULL").join(across, ["f1", "f2"]).select("doc_id", "tid", "a", (F.col("a") + 1).alias("b"))
    spans = found.filter("g1 IS NULL").select("doc_id", "tid", "a", "b").union(late)
    spans = spans.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("a", "b")).alias("more"))
    whole = F.transform(F.filter("runs", lambda r: r["known"]), lambda r: F.struct(r["start"].alias("a"), (r["start"] + r["size"]).alias("b")))
    both = holders.withColumn("known", whole).join(spans, ["doc_id", "tid"], "left")
    both = both.select("doc_id", "text", F.when(F.col("more").isNull(), F.col("known")).otherwise(F.concat("known", "more")).alias("windows"))
    plain = met.filter("runs IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return plain.unionByName(_removed(both, width))


def _removed(both: DataFrame, width: int) -> DataFrame:
    def work(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for raw, windows in zip(blobs(batch), batch.column(2).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((w["a"], w["b"] + width - 1) for w in windows):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            edges = [0, *(x for span in merged for x in span), len(raw)]
            kept = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                kept.update(raw[a:b])
            row = (len(raw), sum(b - a for a, b in merged), len(merged), kept.hexdigest(), [{"start": a, "end": b} for a, b in merged])
            for column, x in zip(out.values(), row, strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return {"doc_id": batch.column(0)} | {k: pa.array(v, kind) for (k, v), kind in zip(out.items(), kinds, strict=True)}

    return over_texts(both, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")
