"""Quality rules on repetition: a suffix array over the words of each document.

The suffixes of one slice of documents are sorted together by prefix doubling;
a word's first rank includes its document, so suffixes of different documents
never compare equal. The longest common prefixes of neighbours give, for each
suffix, the depth of the deepest LCP interval that holds it: the longest
substring starting there that occurs again in the document. The union of those
spans is the union of all maximal repeated substrings' occurrences. No shuffle."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.common import Ids, blobs, over_texts, slices, texts

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


def longest_repeats(codes: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring that starts there
    and at another position too. codes: words as numbers, different in different
    documents."""
    n = len(codes)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    _, rank = np.unique(codes, return_inverse=True)
    levels, k = [rank.astype(np.int64)], 1
    order = np.argsort(rank, kind="stable")
    while True:
        rank = levels[-1]
        sorted_rank = rank[order]
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if not tied.any():
            break
        slots = np.flatnonzero(tied)  # places in `order` of suffixes not yet told apart
        at = order[slots]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)], -1)
        by = np.lexsort((after, rank[at]))
        at, after = at[by], after[by]
        order[slots] = at
        first = np.concatenate(([True], (rank[at][1:] != rank[at][:-1]) | (after[1:] != after[:-1])))
        # a group's rank is the place of its first suffix; ranks of told-apart suffixes stay unique
        new = _places(rank, order)
        new[at] = np.maximum.accumulate(np.where(first, slots, 0))
        levels.append(new)
        k *= 2
    # Longest common prefix of neighbours, by descending powers of two.
    a, b = order[:-1].copy(), order[1:].copy()
    start_b, lcp = b.copy(), np.zeros(n - 1, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    depth = np.zeros(len(live), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((a < n) & (b < n))
        equal = inside[levels[level][a[inside]] == levels[level][b[inside]]]
        depth[equal] += 1 << level
        a[equal] += 1 << level
        b[equal] += 1 << level
    lcp[live] = depth
    np.maximum.at(best, order[:-1], lcp)
    best[start_b] = np.maximum(best[start_b], lcp)
    return best


def _places(rank: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks as the place of the first suffix of each group."""
    sorted_rank = rank[order]
    first = np.concatenate(([True], sorted_rank[1:] != sorted_rank[:-1]))
    out = np.empty(len(rank), np.int64)
    out[order] = np.maximum.accumulate(np.where(first, np.arange(len(rank)), 0))
    return out


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """True where a repeated substring of `least` words or more covers the word."""
    n = len(best)
    starts = np.flatnonzero(best >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + best[starts], -1)
    return np.cumsum(edge[:n]) > 0


def measure(batch: pa.RecordBatch, base_window: int, min_repeat: int) -> dict[str, np.ndarray]:
    """The figures of each document of a batch, by name."""
    raw = blobs(batch)
    words = [t.split() for t in raw]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    known = Ids()
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(starts[-1]))
    doc = np.repeat(np.arange(len(raw)), np.diff(starts))
    best = longest_repeats(doc * (len(known) + 1) + flat)
    total = lambda x: np.add.reduceat(np.concatenate((x, [0])), starts[:-1]) * (np.diff(starts) > 0) if len(raw) else x
    strings = [t.decode("utf-8", "replace") for t in raw]

    def dup_lines(text: str) -> int:
        seen: set[str] = set()
        lines = [x for x in text.split("\n") if x.strip(WHITE)]
        seen.update(lines)
        return len(lines) - len(seen)

    longest = np.zeros(len(raw), np.int64)
    np.maximum.at(longest, doc, best)
    return {
        "n_words": np.diff(starts),
        "word_chars": np.array([len(s) - sum(map(s.count, WHITE)) for s in strings], np.int64),
        "n_symbols": np.array([sum(map(s.count, SYMBOLS)) for s in strings], np.int64),
        "n_dup_lines": np.array([dup_lines(s) if "\n" in s else 0 for s in strings], np.int64),
        "n_repeat_words": total(covered(best, base_window).astype(np.int64)),
        "n_covered_words": total(covered(best, min_repeat).astype(np.int64)),
        "longest_repeat": longest,
    }


def verdicts(m: dict[str, np.ndarray], min_words: int, max_base_pct: int, max_covered_pct: int, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_base_pct * m["n_words"])
    bad = (100 * m["n_covered_words"] > max_covered_pct * m["n_words"]) | (m["longest_repeat"] > max_longest)
    return failed, ~failed & ~bad


#: Production limits: base window of 3 words; repeats of 10 words or more may
#: cover 30 % of a document; no repeat may be longer than 200 words.
LIMITS = {"min_words": 50, "max_base_pct": 50, "max_covered_pct": 30, "max_longest": 200}


def repetition_quality(docs: DataFrame, base_window: int = 3, min_repeat: int = 10, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, n_covered_words,
    longest_repeat.

    Defined cases: a null or empty text has no words, all figures 0, and fails;
    repeated rows give repeated rows; a null doc_id stays null; an empty table
    gives an empty one; texts of any length are taken whole."""
    limits = LIMITS | limits

    def work(batch: pa.RecordBatch) -> dict:
        m = measure(batch, base_window, min_repeat)
        failed, kept = verdicts(m, **limits)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        out = {"doc_id": batch.column(0)} | {k: pa.array(m[k], pa.int64()) for k in names}
        out |= {"base_failed": pa.array(failed), "kept": pa.array(kept)}
        return out | {k: pa.array(m[k], pa.int64()) for k in ("n_covered_words", "longest_repeat")}

    return over_texts(
        texts(docs, id_col, text_col),
        work,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long",
    )


def keep_quality(docs: DataFrame, base_window: int = 3, min_repeat: int = 10, text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are. One pass,
    no shuffle."""
    limits = LIMITS | limits

    def run(batches):
        for batch in slices(batches, text_col):
            one = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col))], ["text"])
            yield batch.filter(pa.array(verdicts(measure(one, base_window, min_repeat), **limits)[1]))

    return docs.mapInArrow(run, docs.schema)
