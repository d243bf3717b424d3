"""MinHash near-dedup by a multi-index Hamming join.

A document becomes the set of its distinct word shingles and a signature of 84
minima, 8 bits of each. Signatures are cut into 14 chunks of 6 symbols. Two
signatures that differ in 27 symbols or fewer differ in at most one symbol of
some chunk (pigeonhole: 14 chunks with two errors each need 28), so each chunk
gives six keys, one for each symbol left out, and every such pair shares a key.
At similarity 0.8 a signature differs in 17 symbols on average. Pairs up to
`reach` symbols apart that share a key are looked at as well. A link of that
similarity shares no key with a calculated chance of 3.1e-7 and is beyond the
reach of 38 with 4e-8; it is lost with 3.5e-7 (`chance_lost`), a closer one with
less.

Every link is confirmed on the full sets. Equal sets are one class from the
start. No step writes the pairs of a group:

* In each key, signatures tell what can be linked, and only pairs that join it
  come out (fewer than members). Their components are families; all links lie
  within families.
* A family is dealt into blocks of bounded shingles. A task holds a block with
  its full sets, compares across what is not joined yet, and again only links
  that join come out.
* A family of several blocks is joined as far as the blocks go; documents outside
  its largest component then meet every block. Documents that are compared by
  such a block are rows for each block, so these grow with the product of the
  outsiders and the family's shingles over `room`."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import blobs, cut, mix, ngrams, over_texts, texts, word_arrays
from changeloom.llm.components import components

CHUNKS, WIDTH = 14, 6
SYMBOLS, REACH = CHUNKS * WIDTH, 38
#: Documents of a family that all its blocks see; it saves work, no result depends on it.
COMMON = 64
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def chance_lost(similarity: float, reach: int = REACH) -> float:
    """The calculated chance that a pair shares no key or is beyond reach."""
    apart = (1 - similarity) * 255 / 256
    chunk = np.array([comb(WIDTH, k) * apart**k * (1 - apart) ** (WIDTH - k) for k in range(WIDTH + 1)])
    every, keyless = np.ones(1), np.ones(1)  # by the number of differing symbols
    for _ in range(CHUNKS):
        every, keyless = np.convolve(every, chunk), np.convolve(keyless, np.where(np.arange(WIDTH + 1) > 1, chunk, 0))
    return float(every[reach + 1 :].sum() + keyless[: reach + 1].sum())


def shingle_sets(raw: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, concatenated, and the
    number for each text. A text of fewer words has one shingle, all of them."""
    split = [t.lower().split() for t in raw]
    flat, starts = word_arrays(split)
    h, doc, _ = ngrams(flat, starts, words)
    sizes = np.diff(starts)
    short = np.flatnonzero((sizes > 0) & (sizes < words))
    if len(short):
        whole = []
        for d in short:
            x = np.full(1, sizes[d], np.uint64)
            for w in flat[starts[d] : starts[d + 1]]:
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w)
            whole.append(x[0])
        h, doc = np.concatenate((h, np.array(whole, np.uint64))), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[first], doc[first]
    return h, np.bincount(doc, minlength=len(raw)).astype(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, f1, f2, sig): set size, 128-bit fingerprint of the set, and
    the signature (null for an empty set)."""

    def work(batch: pa.RecordBatch) -> dict:
        h, sizes = shingle_sets(blobs(batch), words)
        some = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[some]
        f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        sig = np.zeros((len(some), SYMBOLS), np.uint8)
        if len(some):
            f1[some] = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5)), starts)
            f2[some] = np.add.reduceat(mix(h + np.uint64(0x5BD1E995)), starts)
            for k in range(SYMBOLS):
                low = np.minimum.reduceat(((h ^ _XOR[k]) * _ODD[k]) >> np.uint64(32), starts)
                sig[:, k] = (low ^ (low >> np.uint64(8)) ^ (low >> np.uint64(16)) ^ (low >> np.uint64(24))).astype(np.uint8)
        rows: list[bytes | None] = [None] * len(sizes)
        for row, d in zip(sig, some, strict=True):
            rows[d] = row.tobytes()
        return {"doc_id": batch.column(0), "n": pa.array(sizes), "f1": pa.array(f1.view(np.int64)), "f2": pa.array(f2.view(np.int64)), "sig": pa.array(rows, pa.binary())}

    return over_texts(docs, work, "doc_id long, n long, f1 long, f2 long, sig binary", limit=1 << 20)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SYMBOLS)


def key_of(sig: np.ndarray, chunk: np.ndarray | int, gone: np.ndarray | int) -> np.ndarray:
    """The key of each signature for a chunk with one symbol left out."""
    rows = np.arange(len(sig))
    chunk, gone = np.broadcast_to(chunk, len(sig)), np.broadcast_to(gone, len(sig))
    h = (chunk * WIDTH + gone + 1).astype(np.uint64)
    for k in range(WIDTH - 1):
        at = k + (k >= gone)
        h = (h << np.uint64(8)) | sig[rows, chunk * WIDTH + at]
    return mix(h).view(np.int64)


def chunk_keys(reps: DataFrame) -> DataFrame:
    """(key, id): a key for each symbol of each signature, which it leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            keys = [key_of(sig, c, gone) for c in range(CHUNKS) for gone in range(WIDTH)]
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate(keys)), "id": pa.array(np.tile(ids, SYMBOLS))})

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def overlaps(k: int, others: np.ndarray, flat: np.ndarray, ends: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """How many elements set k shares with each of the others. Set d is
    flat[ends[d]:ends[d + 1]]; mark is all false and stays so."""
    own = flat[ends[k] : ends[k + 1]]
    mark[own] = True
    sizes = ends[others + 1] - ends[others]
    if 4 * int(sizes.sum()) > len(flat):
        shared = np.add.reduceat(mark[flat], ends[:-1], dtype=np.int64)[others]
    else:
        starts = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(ends[others] - starts, sizes)
        shared = np.add.reduceat(mark[flat[at]], starts, dtype=np.int64)
    mark[own] = False
    return shared


def forest(ids: np.ndarray, sig: np.ndarray, sets: pa.ListArray, reach: int, percent: int, label: np.ndarray | None = None, asks: np.ndarray | None = None) -> tuple[list, list]:
    """Links that join what is linked among some documents, fewer than documents.
    Compared are documents of different labels whose sizes and signatures allow
    a link; with `asks`, one of the two is asking."""
    ends = sets.offsets.to_numpy().astype(np.int64)
    ends, values = ends - ends[0], sets.flatten().to_numpy()
    sizes = np.diff(ends)
    distinct, flat = np.unique(values, return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    label = np.arange(len(ids)) if label is None else label.copy()
    a, b = [], []
    for k in range(len(ids) - 1) if asks is None else np.flatnonzero(asks):
        fits = (label != label[k]) & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k]))
        if asks is None:
            fits[:k] = False
        others = np.flatnonzero(fits)
        others = others[(sig[others] != sig[k]).sum(axis=1) <= reach]
        if not len(others):
            continue
        shared = overlaps(k, others, flat, ends, mark)
        for j in others[100 * shared >= percent * (sizes[k] + sizes[others] - shared)]:
            if label[j] != label[k]:
                a.append(int(ids[k]))
                b.append(int(ids[j]))
                label[label == label[j]] = label[k]
    return a, b


def near_in_keys(members: DataFrame, reps: DataFrame, reach: int, percent: int, block: int) -> DataFrame:
    """(a, b): pairs that join, in each key, what signatures and sizes allow to be
    linked, fewer than the key's members. members(key, hub, k, id); in a key of
    over `block` members all are joined with the smallest without a look."""
    many = members.filter((F.col("k") > block) & (F.col("id") != F.col("hub"))).select(F.col("id").alias("a"), F.col("hub").alias("b"))
    rows = members.filter(F.col("k") <= block).select("key", "id").join(reps, "id")
    rows = rows.select("key", "id", "sig", "n").repartition(_parts(members), "key").sortWithinPartitions("key", "id")

    def solve(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, n: np.ndarray) -> tuple[list, list]:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(starts[1:], len(key))
        hub = np.repeat(starts, ends - starts)
        close = lambda i, j: ((sig[i] != sig[j]).sum(axis=1) <= reach) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        every = np.arange(len(key))
        joined = close(every, hub)
        spokes = np.flatnonzero(joined & (every != hub))
        a, b = ids[spokes].tolist(), ids[hub[spokes]].tolist()
        far = np.add.reduceat(~joined, starts, dtype=np.int64)
        for g in np.flatnonzero((far > 0) & (ends - starts > 2)):
            group = every[starts[g] : ends[g]]
            label = np.where(joined[group], 0, np.arange(len(group)))
            for k in np.flatnonzero(~joined[group]):
                others = np.flatnonzero(label != label[k])
                for j in others[close(np.full(len(others), group[k]), group[others])]:
                    if label[j] != label[k]:
                        a.append(int(ids[group[k]]))
                        b.append(int(ids[group[j]]))
                        label[label == label[j]] = label[k]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 1):
            key, ids, n = (table.column(c).to_numpy() for c in ("key", "id", "n"))
            a, b = solve(key, ids, _matrix(table.column("sig")), n)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return many.union(rows.mapInArrow(run, "a long, b long"))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows cut where the first `keys` columns change, so that
    no group is divided; what is held is a batch and one group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        old = [held[-1].column(k)[-1].as_py() for k in range(keys)] if held else None
        if old is not None and any(c[0] != x for c, x in zip(columns, old, strict=True)):
            yield pa.concat_batches(held)
            held = []
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if len(change):
            at = int(change[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, at)])
            held = [batch.slice(at)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _parts(df: DataFrame) -> int:
    """Partitions for work that its bytes do not tell the size of."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def links_in_blocks(source: DataFrame, dealt: DataFrame, words: int, reach: int, percent: int) -> DataFrame:
    """(a, b): links confirmed on full sets that join what is linked in each
    block. dealt(id, family, part, sig, label, ask) names the blocks (family,
    part); label is null where each document stands alone."""
    named = source.withColumnRenamed("doc_id", "id").join(dealt, "id").select("id", "text", "family", "part", "sig", "label", "ask")

    def sets(batch: pa.RecordBatch) -> dict:
        h, sizes = shingle_sets(blobs(batch), words)
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        out = {name: batch.column(batch.schema.get_field_index(name)) for name in ("family", "part", "id", "sig", "label", "ask")}
        return out | {"shingles": pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))}

    rows = over_texts(named, sets, "family long, part long, id long, sig binary, label long, ask boolean, shingles array<long>", limit=1 << 20)
    rows = rows.repartition(_parts(source), "family", "part").sortWithinPartitions("family", "part", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 2):
            family, part = table.column("family").to_numpy(), table.column("part").to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], (family[1:] != family[:-1]) | (part[1:] != part[:-1]))))
            a, b = [], []
            for x, y in zip(starts, [*starts[1:], len(family)], strict=True):
                block = table.slice(int(x), int(y - x))
                alone = block.column("label").null_count == block.num_rows
                more = () if alone else (block.column("label").to_numpy(), block.column("ask").to_numpy(zero_copy_only=False))
                one, two = forest(block.column("id").to_numpy(), _matrix(block.column("sig")), block.column("shingles"), reach, percent, *more)
                a += one
                b += two
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, reach: int = REACH, block: int = 1024, room: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept.

    Linked are documents with 100 * |A & B| >= percent * |A | B| on their sets
    of word shingles (A-Z lower-cased, words between `[\\x20\\x09-\\x0D]`); a
    component's id is its smallest doc_id, and that document is kept. Defined
    cases: without words a set is empty and linked with nothing; rows that share
    a doc_id are one document with several texts; a row without doc_id is linked
    with nothing, has no component and is kept; an empty table gives an empty
    one. A very long text is one set in one block, whatever `room` (shingles of a
    block); `block` is the number of members up to which a key's signatures are
    compared, beyond it all are of one family."""
    source = texts(docs, id_col, text_col)
    sketch = cut(sketches(source, words), "sketches")
    named = sketch.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(named.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "classes")
    reps = classes.select("id", "sig", "n")
    comps = _linked(source, reps, words, percent, reach, block, room)
    placed = (
        sketch.join(classes.select("f1", "f2", "n", "id"), ["f1", "f2", "n"], "left")
        .join(comps.withColumnRenamed("node", "id"), "id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id")).alias("component_id"))
    )
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _linked(source: DataFrame, reps: DataFrame, words: int, percent: int, reach: int, block: int, room: int) -> DataFrame:
    """(node, component) of the classes that are linked with others."""
    keys = chunk_keys(reps)
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    members = cut(keys.join(cut(shared, "shared-keys"), "key"), "members")
    families = cut(components(near_in_keys(members, reps, reach, percent, block)), "families")
    families = families.union(families.select(F.col("component").alias("node"), "component").distinct()).toDF("id", "family")
    placed = cut(families.join(reps, "id"), "placed")
    size = placed.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.sum("n") / room).cast("int").alias("blocks"))
    placed = cut(placed.join(cut(size, "family-sizes"), "family"), "sized")
    # Each block alone, with a few documents of the family that all its blocks see.
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    alone = [F.lit(None).cast("long").alias("label"), F.lit(None).cast("boolean").alias("ask")]
    common = placed.filter((F.col("blocks") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.col("members")) < COMMON))
    common = common.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter(F.col("at") != own)
    dealt = placed.select("id", "family", own.alias("part"), "sig", *alone).union(common.select("id", "family", F.col("at").cast("long"), "sig", *alone))
    comps = components(links_in_blocks(source, dealt, words, reach, percent))
    # Families of several blocks: documents outside the largest component meet every block.
    wide = placed.filter("blocks > 1").withColumnRenamed("id", "node").join(comps, "node", "left")
    wide = cut(wide.withColumn("label", F.coalesce("component", "node")).drop("component"), "wide")
    counts = wide.groupBy("family", "label").agg(F.count(F.lit(1)).alias("held"))
    main = cut(counts.groupBy("family").agg(F.max_by("label", F.struct("held", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("family", "main"), "main")
    if main.isEmpty():
        return comps
    wide = cut(wide.join(main, "family").withColumn("ask", F.col("label") != F.col("main")), "asked")
    asks = cut(wide.filter("ask").groupBy("family").agg(F.ceil(F.sum("n") / room).cast("int").alias("rounds")), "asks")
    wide, own = wide.join(asks, "family"), F.pmod(F.xxhash64("node"), F.col("blocks"))
    turn = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rounds"))
    columns = ["family", "sig", "label", "rounds"]
    held = wide.select(F.col("node").alias("id"), *columns, own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("j"), F.lit(False).alias("ask"))
    asking = wide.filter("ask").select(F.col("node").alias("id"), *columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), turn.alias("j"), F.lit(True).alias("ask"))
    dealt = held.union(asking).select("id", "family", (F.col("i") * F.col("rounds") + F.col("j")).alias("part"), "sig", "label", "ask")
    return _joined(comps, _lifted(links_in_blocks(source, dealt, words, reach, percent), comps))


def _with_component(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    return nodes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _lifted(links: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between documents as links between their components."""
    one = _with_component(links.withColumnRenamed("a", "node"), comps).select(F.col("component").alias("a"), F.col("b").alias("node"))
    return _with_component(one, comps).select("a", F.col("component").alias("b")).filter("a <> b")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between components."""
    more = cut(components(links), "merged")
    moved = comps.join(more.toDF("component", "later"), "component", "left").select("node", F.coalesce("later", "component").alias("component"))
    return moved.union(more.join(comps, "node", "left_anti"))


def keep_first(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose document is the one that stays of its component."""
    gone = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
