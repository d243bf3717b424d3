"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(group | class, history) * P(word | group).
Classes are 12 single words, 12 bins of further frequent words and 8 of the rest;
a class is dealt into 32 groups. Both trained factors are softmaxes over 32, whose
logits are the log shares plus the weights of three hashed features: the last
word, the last two words, and the word before the last alone (a skip feature); the
inner factor's rows are hashed together with the class. Within a group the
add-one estimate of the base score is renormalised; so the model's score is the
base score plus what the trained factors gain over the shares.

Counts cover all training documents and are a distributed table. Words frequent
enough to be among the `head` (a bounded number, found from a histogram of the
counts) are known to every worker; all other words meet their counts in a join.
Texts are split into words twice: to be counted, and to become rows of 32-bit word
codes, from which both training and scoring work.

Training documents are dealt into shards by a hash of their id and text. Each
shard takes Adagrad steps from the common weights; the changes are averaged row by
row, by how often a shard saw the row, and shrunk where all shards together saw it
rarely. Rows a template grow with the square root of the training tokens, as
distinct words do, up to `most_rows`; a shard has 512 tokens a row, so that what
shards send stays in proportion to the text. Neither depends on the cluster."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from math import ceil, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import blobs, cut, mix, over_texts, signed, slices, texts

#: Counted after the words of each text; no word holds a blank.
END = b"\n"
CLASSES, SINGLES, BINS = 32, 12, 12  # frequent words alone, bins of equal mass, and the rest by ending
TAILS = CLASSES - SINGLES - BINS
GROUPS, TEMPLATES, LEVELS = 32, 3, 2
ROWS, GROWS_FROM = 1 << 13, 1 << 24  # rows a template, up to this number of tokens
BATCH = 8192
#: A code is an index into the head, or has this bit, 23 bits of a hash, the class
#: (3 bits) and the group (5 bits).
RARE = 1 << 31
#: Distinct words that a counting worker holds.
HELD = 200_000
_ONES = np.ones(CLASSES, np.float32)


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 7, is 2; a null id reads as ''."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _tokens(raw: list[bytes]) -> list[list[bytes]]:
    return [[*t.lower().split(), END] for t in raw]


def _training(batch: pa.RecordBatch) -> list[bytes]:
    return [t for t, d in zip(blobs(batch), batch.column(0).to_pylist(), strict=True) if not held_out(d)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the training documents."""

    def rows(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()).cast(pa.string()), "n": pa.array(seen.values(), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for words in _tokens(_training(batch)):
                seen.update(words)
            if len(seen) > HELD:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _rare_code(word: bytes) -> int:
    """The class of a rare word is told by its ending, its group by a hash."""
    h = xxhash.xxh3_64_intdigest(word)
    return RARE | (h & 0x7FFFFF) << 8 | xxhash.xxh32_intdigest(word[-2:]) % TAILS << 5 | h >> 59


class Head:
    """The frequent words: counts, classes and groups, and the shares of all."""

    def __init__(self, rows: list[tuple[str, int]], total: int, distinct: int):
        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        self.total, self.distinct = total, distinct
        self.words = {w.encode(): k for k, (w, _) in enumerate(rows)}
        self.counts = np.array([c for _, c in rows], np.int64)
        rest = self.counts[SINGLES:]
        leaf = (np.cumsum(rest) - rest) * (BINS * GROUPS) // max(1, int(rest.sum())) if len(rest) else rest
        self.leaves = np.concatenate((np.arange(min(SINGLES, len(rows))) * GROUPS, SINGLES * GROUPS + leaf)).astype(np.int64)
        self.share, self.inner = np.zeros(CLASSES), np.zeros((CLASSES, GROUPS))

    def shares(self, tail: dict[int, int]) -> None:
        """tail: leaf -> sum of c + 1 over the words outside the head. A word
        never seen has a mass of 1, dealt over the tail classes."""
        mass = np.bincount(self.leaves, self.counts + 1, CLASSES * GROUPS).astype(np.float64)
        for k, m in tail.items():
            mass[k] += m
        mass[(SINGLES + BINS) * GROUPS :] += 1 / (TAILS * GROUPS)
        mass = np.maximum(mass.reshape(CLASSES, GROUPS), 1e-9)
        self.share = mass.sum(axis=1) / max(1, self.total + self.distinct + 1)
        self.inner = mass / mass.sum(axis=1, keepdims=True)

    def leaves_of(self, codes: np.ndarray) -> np.ndarray:
        rare = codes >= RARE
        out = (SINGLES + BINS) * GROUPS + (codes & np.uint32(0xFF)).astype(np.int64)
        out[~rare] = self.leaves[codes[~rare]]
        return out


def _features(codes: np.ndarray, starts: np.ndarray, leaves: np.ndarray, rows: int) -> list[np.ndarray]:
    """The rows of each token: a (tokens x templates) array for each level."""
    none = np.uint64(RARE - 1)  # before the first word; no head is that large
    before, before2 = np.full(len(codes), none), np.full(len(codes), none)
    before[1:], before2[2:] = codes[:-1], codes[:-2]
    first = starts[:-1]  # each text has a token at least
    before[first], before2[first] = none, none
    before2[first[np.diff(starts) > 1] + 1] = none
    words = [mix(before + np.uint64(1 << 32)), mix((before << np.uint64(32)) + before2), mix(before2 + np.uint64(1 << 33))]
    classes = (leaves // GROUPS).astype(np.uint64) << np.uint64(7)
    shift, kind = np.uint64(64 - (rows.bit_length() - 1)), np.uint16 if rows <= 1 << 16 else np.int64
    outer = [(w >> shift).astype(kind) for w in words]
    inner = [(mix(w + classes) >> shift).astype(kind) for w in words]
    return [np.stack(outer), np.stack(inner)]


def _logits(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """weights: (templates, rows, choices); bias: (choices) or (tokens, choices)."""
    out = weights[0].take(features[0], axis=0)
    for k in range(1, TEMPLATES):
        out += weights[k].take(features[k], axis=0)
    out += bias
    return out


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, from each `first` up to the next. Most stretches
    are short: those of four rows or fewer are added row by row, all at once."""
    lengths = np.diff(np.append(first, len(values)))
    total = values.take(first, axis=0)
    for k in range(1, 4):
        at = np.flatnonzero((lengths > k) & (lengths <= 4))
        total[at] += values.take(first[at] + k, axis=0)
    long = np.flatnonzero(lengths > 4)
    if len(long):
        ends = np.cumsum(lengths[long])
        starts = ends - lengths[long]
        rows = np.arange(ends[-1]) + np.repeat(first[long] - starts, lengths[long])
        total[long] = np.add.reduceat(values.take(rows, axis=0), starts, axis=0)
    return total


def _step(weights: np.ndarray, squares: np.ndarray, bias: np.ndarray, features: np.ndarray, chosen: np.ndarray, rate: float) -> None:
    """One Adagrad update from a batch of tokens."""
    gradient = np.exp(_logits(weights, bias, features))
    gradient /= (gradient @ _ONES)[:, None]
    gradient[np.arange(len(chosen)), chosen] -= 1
    for k in range(TEMPLATES):
        order = np.argsort(features[k], kind="stable")
        column = features[k][order]
        first = np.flatnonzero(np.concatenate(([True], column[1:] != column[:-1])))
        rows, total = column[first], _sums(gradient.take(order, axis=0), first)
        squares[k, rows] += np.einsum("ij,ij->i", total, total) / total.shape[1]
        weights[k, rows] -= total * (rate / np.sqrt(squares[k, rows] + 1e-3))[:, None]


def encoded(docs: DataFrame, known) -> DataFrame:
    """(doc_id, tid, held_out, codes, rare, times): each text's word codes (32 bits
    each) and its rare words with how often they occur in it."""

    def work(batch: pa.RecordBatch) -> dict:
        raw, head = blobs(batch), known.value.words

        class Codes(dict):
            def __missing__(self, word):
                self[word] = code = head[word] if word in head else _rare_code(word)
                return code

        words = _tokens(raw)
        every = list(chain.from_iterable(words))
        codes = np.fromiter(map(Codes().__getitem__, every), np.uint32, len(every))
        ends = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        at = np.flatnonzero(codes >= RARE)
        cuts = np.searchsorted(at, ends)
        rare = [Counter([every[i] for i in at[a:b].tolist()]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        ids, kept = batch.column(0).to_pylist(), codes.tobytes()
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rare]))).astype(np.int32))
        flat = pa.array(list(chain.from_iterable(rare)), pa.binary()).cast(pa.string())
        return {
            "doc_id": batch.column(0),
            "tid": pa.array([signed(xxhash.xxh64_intdigest(t, seed=42)) for t in raw], pa.int64()),
            "held_out": pa.array([held_out(d) for d in ids], pa.bool_()),
            "codes": pa.array([kept[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()),
            "rare": pa.ListArray.from_arrays(offsets, flat),
            "times": pa.ListArray.from_arrays(offsets, pa.array(list(chain.from_iterable(r.values() for r in rare)), pa.int32())),
        }

    return over_texts(docs, work, "doc_id long, tid long, held_out boolean, codes binary, rare array<string>, times array<int>")


def _coded(batch: pa.RecordBatch, head: Head, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Codes, starts of the texts in them, leaves and features of a batch."""
    raw = batch.column(batch.schema.get_field_index("codes")).to_pylist()
    codes = np.frombuffer(b"".join(raw), np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int64)
    leaves = head.leaves_of(codes)
    return codes, starts, leaves, _features(codes, starts, leaves, rows)


def model_rows(tokens: int, most_rows: int) -> int:
    """Rows a template: a power of two that grows with the root of the tokens."""
    rows = ROWS
    while rows < most_rows and (rows * 2 // ROWS) ** 2 * GROWS_FROM <= tokens:
        rows *= 2
    return rows


def train(coded: DataFrame, head: Head, rows: int, rounds: int = 1, rate: float = 0.1, shrink: float = 20.0) -> np.ndarray:
    """The weights (levels, templates, rows, choices) after some rounds over all
    training documents of coded(doc_id, tid, held_out, codes)."""
    context = coded.sparkSession.sparkContext
    shards = max(1, ceil(head.total / (512 * rows)))
    dealt = coded.filter("NOT held_out").select(F.pmod(F.xxhash64("doc_id", "tid", F.lit(5)), F.lit(shards)).cast("int").alias("shard"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tid", "codes")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id", "tid")
    weights = np.zeros((LEVELS, TEMPLATES, rows, CLASSES), np.float32)
    bias, inner = np.log(head.share).astype(np.float32), np.log(head.inner).astype(np.float32)
    known = context.broadcast(head)  # a bounded number of words
    for _ in range(rounds):
        common = context.broadcast(weights)  # of the model's size

        def learn(batches: Iterator[pa.RecordBatch], common=common) -> Iterator[pa.RecordBatch]:
            own = squares = seen = shard = None

            def told() -> Iterator[pa.RecordBatch]:
                flat, was = own.reshape(-1, CLASSES), common.value.reshape(-1, CLASSES)
                touched = np.flatnonzero(seen)
                for a in range(0, len(touched), 4096):
                    at = touched[a : a + 4096]
                    change = (flat[at] - was[at]).astype(np.float16)
                    yield pa.RecordBatch.from_pydict({"row": pa.array(at, pa.int32()), "n": pa.array(seen.ravel()[at]), "w": pa.array([x.tobytes() for x in change], pa.binary())})

            for batch in by_shard(slices(batches, "codes", 1 << 20)):
                if batch.column(0)[0].as_py() != shard:
                    if shard is not None:
                        yield from told()
                    shard, own = batch.column(0)[0].as_py(), common.value.copy()
                    squares, seen = np.zeros(own.shape[:3], np.float32), np.zeros(own.shape[:3], np.int64)
                _, _, leaves, features = _coded(batch, known.value, rows)
                classes, groups = leaves // GROUPS, leaves % GROUPS
                some = np.flatnonzero(classes >= SINGLES)  # a single word has no groups
                for level, (choice, at) in enumerate(((classes, slice(None)), (groups, some))):
                    f, chosen, of = features[level][:, at], choice[at], classes[at]
                    for k in range(TEMPLATES):
                        seen[level, k] += np.bincount(f[k], minlength=rows)
                    for a in range(0, len(chosen), BATCH):
                        part = slice(a, a + BATCH)
                        _step(own[level], squares[level], inner[of[part]] if level else bias, f[:, part], chosen[part], rate)
            if shard is not None:
                yield from told()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                at, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                w = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(-1, CLASSES)
                both = np.concatenate((w.astype(np.float64) * n[:, None], n[:, None]), axis=1)
                for row, x in zip(at.tolist(), both, strict=True):
                    total[row] = total[row] + x if row in total else x
            if total:
                means = [(x[:-1] / (x[-1] + shrink)).astype(np.float32).tobytes() for x in total.values()]
                yield pa.RecordBatch.from_pydict({"row": pa.array(list(total), pa.int32()), "w": pa.array(means, pa.binary())})

        learned = dealt.mapInArrow(learn, "row int, n long, w binary")
        weights = weights.copy()
        flat = weights.reshape(-1, CLASSES)
        for row in learned.repartition("row").mapInArrow(average, "row int, w binary").toLocalIterator():
            flat[row.row] += np.frombuffer(row.w, np.float32)
        np.clip(weights, -20, 20, out=weights)  # exponentials stay finite
    return weights


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of one shard each (the first column)."""
    for batch in batches:
        shard = batch.column(0).to_numpy()
        cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(shard)], strict=True):
            yield batch.slice(int(a), int(b - a))


def gains(batch: pa.RecordBatch, head: Head, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts, and for each token what the model's log10 probability is
    above the base's."""
    codes, starts, leaves, features = _coded(batch, head, weights.shape[2])
    classes, groups = leaves // GROUPS, leaves % GROUPS
    bias, inner = np.log(head.share).astype(np.float32), np.log(head.inner).astype(np.float32)
    gain = np.zeros(len(codes))
    some = np.flatnonzero(classes >= SINGLES)
    for level, (choice, at) in enumerate(((classes, np.arange(len(codes))), (groups, some))):
        for a in range(0, len(at), BATCH):
            part = at[a : a + BATCH]
            own = inner[classes[part]] if level else bias
            logits = _logits(weights[level], own, features[level][:, part])
            every, chosen = np.arange(len(part)), choice[part]
            gain[part] += logits[every, chosen] - np.log(np.exp(logits) @ _ONES) - (own[every, chosen] if level else own[chosen])
    return codes, starts, gain / np.log(10)


def find_head(counts: DataFrame, most: int) -> Head:
    """The words with counts over a bound that leaves `most` of them at most. The
    bound comes from a histogram of counts in steps of a sixteenth of a power of
    two, so that only its bins and the head itself reach the driver."""
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("s")).collect()
    room, least = most, None
    for row in sorted(bins, key=lambda r: -r.bin):
        room -= row.k
        if room < 0:
            break
        least = row.bin
    chosen = [] if least is None else counts.filter(step >= least).collect()
    head = Head([(r.word, r.c) for r in chosen], sum(r.s for r in bins), sum(r.k for r in bins))
    tail = counts if least is None else counts.filter(step < least)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass: Counter = Counter()
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mass[(SINGLES + BINS) * GROUPS + (_rare_code(word.encode()) & 0xFF)] += c + 1
        yield pa.RecordBatch.from_pydict({"k": pa.array(mass.keys(), pa.int32()), "m": pa.array(mass.values(), pa.int64())})

    masses = tail.select("word", "c").mapInArrow(classed, "k int, m long").groupBy("k").agg(F.sum("m").alias("m")).collect()
    head.shares({r.k: r.m for r in masses})
    return head


def score_texts(docs: DataFrame, head_words: int = 1 << 18, rounds: int = 1, rate: float = 0.1, most_rows: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score; scores are log10 probabilities.

    The model learns from documents whose crc32(doc_id as text) modulo 7 is not
    2. Defined cases: a null or empty text is the end token alone; a null doc_id
    reads as '' and is for training; equal rows count each time; without
    training documents every token is unknown; a very long text is one slice of
    its own; an empty table gives an empty one."""
    source = texts(docs, id_col, text_col)
    counts = cut(word_counts(source), "word-counts")
    head = find_head(counts, head_words)
    context = docs.sparkSession.sparkContext
    known = context.broadcast(head)
    coded = cut(encoded(source, known), "coded")
    model = context.broadcast(train(coded, head, model_rows(head.total, most_rows), rounds, rate))
    smallest = F.lit(-(1 << 63)).cast("long")  # stands for a null id in joins
    keyed = coded.withColumn("k", F.coalesce("doc_id", smallest))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = known.value
        for batch in slices(batches, "codes", 1 << 20):
            codes, starts, gain = gains(batch, head, model.value)
            inside = codes < RARE
            logs = np.zeros(len(codes))
            logs[inside] = np.log10(head.counts[codes[inside]] + 1.0)
            sums = lambda x, at=starts[:-1]: pa.array(np.add.reduceat(x, at))
            own = {name: batch.column(k) for k, name in enumerate(("doc_id", "k", "tid", "held_out"))}
            yield pa.RecordBatch.from_pydict(own | {"n_tokens": pa.array(np.diff(starts)), "n_head": sums(inside.astype(np.int64)), "head_logs": sums(logs), "gain": sums(gain)})

    whole = keyed.select("doc_id", "k", "tid", "held_out", "codes").mapInArrow(score, "doc_id long, k long, tid long, held_out boolean, n_tokens long, n_head long, head_logs double, gain double")
    rare = keyed.select("k", "tid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("k", "tid", F.col("r.rare").alias("word"), F.col("r.times").alias("n"))
    copies = keyed.groupBy("k", "tid").agg(F.count(F.lit(1)).alias("copies"))  # equal rows; their sums come together
    met = rare.join(counts, "word")
    sums = met.groupBy("k", "tid").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"), F.sum("n").alias("n"))
    sums = sums.join(copies, ["k", "tid"]).select("k", "tid", (F.col("logs") / F.col("copies")).alias("logs"), (F.col("n") / F.col("copies")).cast("long").alias("n_rare"))
    joined = whole.join(sums, ["k", "tid"], "left")
    size = log10(head.total + head.distinct + 1)
    base = F.col("head_logs") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(size)
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(head.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (base + F.col("gain")).alias("score"),
    )
