"""Benchmark decontamination: rare n-gram seeds join passages to test items, then
Smith-Waterman alignment scores edited copies. Found are alignments with a good
share of an item, and passages of an item, however long it is, that are copied
nearly word for word.

The test items are the query set. They are read in blocks of a bounded number of
seeds; each block travels to the workers (its size is checked while it is
filled), and every document streams past it: no shuffle with one block, one
aggregation by document with several. A seed is rare if few items hold it; the
corpus does not count, as a leaked passage may be frequent there. An item
without a rare seed uses all it has."""

from __future__ import annotations

from collections import Counter, defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import blobs, cut, over_texts, slices, texts

#: As in prose: letters, digits and all non-ASCII characters make words.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MATCH, MISS, GAP = 2, -1, -1
#: An excerpt is PASSAGE words of an item, with more equal words for each edit.
PASSAGE, EDIT = 13, -3
HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
HIT_SQL = "array<struct<item_id:long,score:double,first_word:long,end_word:long>>"


def lowered(text: bytes) -> bytes:
    """All letters in lower case, not A-Z alone."""
    return text.decode("utf-8", "replace").lower().encode()


def align(a: np.ndarray, b: np.ndarray, match: int = MATCH, miss: int = MISS, gap: int = GAP) -> tuple[int, int, int]:
    """Best local alignment of a against b with linear gaps: (score, end in a,
    end in b). One vector step for each word of a."""
    at = np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(a.tolist()):
        step = np.zeros(len(b) + 1, np.int64)
        np.maximum(row[:-1] + np.where(b == word, match, miss), row[1:] + gap, out=step[1:])
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step - gap * at) + gap * at  # gaps along b
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), i + 1, k)
    return best


def excerpt(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b holds a passage of a: each edit takes as many words from its
    length as -EDIT. Over 3 in 4 of its words are equal, whatever else fits."""
    return align(a, b, 1, EDIT, EDIT)[0] >= PASSAGE


class Items:
    """A block of test items: vocabulary, seeds and postings."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, max_items: int):
        self.n = n
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = lowered(text).translate(WORDS).split()
            if words:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64)))
        held: Counter = Counter()
        grams = []
        for _, ids in self.items:
            own = {k: tuple(ids[k : k + n].tolist()) for k in range(max(1, len(ids) - n + 1))}
            grams.append(own)
            held.update(set(own.values()))
        self.postings: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, own in enumerate(grams):
            rare = {k: g for k, g in own.items() if held[g] <= max_items}
            for k, g in (rare or own).items():
                self.postings[g].append((item, k))
        self.short = sorted({len(g) for g in self.postings if len(g) < n})
        codes = [self.code(np.array(g, np.int64)) for g in self.postings if len(g) == n]
        self.codes = np.unique(np.array(codes, np.uint64)) if codes else np.zeros(0, np.uint64)

    @staticmethod
    def code(gram: np.ndarray) -> np.uint64:
        out = np.zeros(1, np.uint64)
        for x in gram.astype(np.uint64):
            out = out * np.uint64(0x9E3779B97F4A7C15) + x
        return out[0]

    def hits(self, ids: np.ndarray) -> dict[int, list[int]]:
        """item -> places in the document where one of its seeds starts."""
        out: dict[int, list[int]] = defaultdict(list)
        for n in (*self.short, self.n):
            if len(ids) < n:
                continue
            size = len(ids) - n + 1
            whole = ids[:size] > 0
            code = np.zeros(size, np.uint64)
            for k in range(n):
                part = ids[k : k + size]
                whole &= part > 0
                code = code * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
            places = np.flatnonzero(whole)
            if n == self.n and len(places) and len(self.codes):
                code = code[places]
                found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                places = places[self.codes[found] == code]
            for k in places.tolist():
                for item, _ in self.postings.get(tuple(ids[k : k + n].tolist()), ()):
                    out[item].append(k)
        return out

    def matches(self, ids: np.ndarray, least: float) -> list[dict]:
        """Items whose alignment with some passage scores `least` or more, and
        those of which the document holds an excerpt."""
        found = []
        for item, places in self.hits(ids).items():
            item_id, words = self.items[item]
            size, best = len(words), None
            places.sort()
            first = places[0]
            for place, after in zip(places, [*places[1:], None], strict=True):
                if after is not None and after - place <= 2 * size:
                    continue
                a, b = max(0, first - 2 * size), min(len(ids), place + 2 * size + self.n)
                score, end_a, end_b = align(words, ids[a:b])
                share = score / (MATCH * size)
                # An excerpt scores MATCH * PASSAGE at least in the looser alignment too.
                held = share >= least or (score >= MATCH * PASSAGE and excerpt(words, ids[a:b]))
                if held and (best is None or share > best["score"]):
                    back = align(words[:end_a][::-1], ids[a : a + end_b][::-1])
                    best = {"item_id": item_id, "score": share, "first_word": a + end_b - back[2], "end_word": a + end_b}
                first = after
            if best:
                found.append(best)
        return sorted(found, key=lambda x: (x["item_id"], x["first_word"]))

    def word_ids(self, raw: list[bytes]) -> list[np.ndarray]:
        get, out = self.vocabulary.get, []
        for text in raw:
            words = lowered(text).translate(WORDS).split()
            out.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        return out


def item_blocks(benchmark: DataFrame, n: int, max_items: int, block_words: int, id_col: str = "item_id", text_col: str = "text") -> list:
    """Spark broadcasts of Items, of block_words words each at most (or one item)."""
    blocks, part, size = [], [], 0
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull()).toLocalIterator()
    for item_id, text in rows:
        words = len(text.split())
        if part and size + words > block_words:
            blocks.append(context.broadcast(Items(part, n, max_items)))
            part, size = [], 0
        part.append((item_id, text.encode()))
        size += words
    blocks.append(context.broadcast(Items(part, n, max_items)))
    return blocks


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 4,
    max_items: int = 3,
    least: float = 0.5,
    block_words: int = 1_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each row of docs: doc_id, contaminated, best_score, n_items,
    item_ids, hits (array of item_id, score, first word, end word).

    The score is the alignment's share of the item's own full score. A document
    is contaminated from a share of `least` on, or by an excerpt of any share: 13
    words of an item in a row, or more of them with single edits. Defined cases:
    null and empty texts or items match nothing; an item shorter than n words is
    its own seed; a null item_id is reported as null; equal rows give equal rows;
    a very long text is aligned only around its seeds; without items no document
    is contaminated; an empty table gives an empty one."""
    source, found = texts(docs, id_col, text_col), None
    blocks = item_blocks(benchmark, n, max_items, block_words)
    if len(blocks) > 1:
        source = cut(source.withColumn("__row", F.monotonically_increasing_id()), "numbered")  # the same numbers for each block
    for block in blocks:

        def work(batch: pa.RecordBatch, block=block) -> dict:
            items = block.value
            rows = [items.matches(ids, least) for ids in items.word_ids(blobs(batch))]
            out = {"doc_id": batch.column(0), "hits": pa.array(rows, HIT)}
            return out if batch.num_columns == 2 else out | {"__row": batch.column(2)}

        part = over_texts(source, work, f"doc_id long, hits {HIT_SQL}" + ", __row long" * (len(blocks) > 1))
        found = part if found is None else found.union(part)
    if len(blocks) > 1:
        found = found.groupBy("__row", "doc_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return found.select(
        "doc_id",
        (F.size("hits") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("best_score"),
        F.size("hits").cast("long").alias("n_items"),
        F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
        "hits",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, max_items: int = 3, least: float = 0.5, block_words: int = 1_000_000, text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of the benchmark, all columns as
    they are. One pass for each block of items, no shuffle."""
    for block in item_blocks(benchmark, n, max_items, block_words):

        def run(batches, block=block):
            for batch in slices(batches, text_col):
                clean = [not block.value.matches(ids, least) for ids in block.value.word_ids(blobs(batch, text_col))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
