import random

import numpy as np

from changeloom.llm.common import Ids
from changeloom.llm.repetition import keep_quality, longest_repeats, repetition_quality

from .helpers import corpus, documents, words


def brute_longest(ws):
    n = len(ws)

    def common(i, j):
        k = 0
        while max(i, j) + k < n and ws[i + k] == ws[j + k]:
            k += 1
        return k

    return [max((common(i, j) for j in range(n) if j != i), default=0) for i in range(n)]


def test_suffix_array_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        docs = [[rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))] for _ in range(4)]
        ids = Ids()
        codes = np.array([d * 10 + ids[w] for d, ws in enumerate(docs) for w in ws], np.int64)
        assert longest_repeats(codes).tolist() == [x for ws in docs for x in brute_longest(ws)]


def brute(text):
    ws, text = words(text), text or ""
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    n_repeat = len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)})
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(ws) < 50 or 100 * n_repeat > 50 * len(ws)
    longest = brute_longest(ws)
    cover = len({i + k for i, m in enumerate(longest) if m >= 10 for k in range(m)})
    kept = not failed and 100 * cover <= 30 * len(ws) and max(longest, default=0) <= 200
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), n_repeat, failed, kept, cover, max(longest, default=0)


def test_rows_against_brute_force(spark):
    rows = corpus(1) + [(100, "a b c " * 40), (101, "x # y | z\n" * 3), (102, " ".join(f"w{i}" for i in range(80))), (103, "é ñ \x1c ok")]
    got = {r.doc_id: tuple(r)[1:] for r in repetition_quality(documents(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_filter_keeps_clean_rows_whole(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [(1, clean), (2, "too short"), (None, clean), (3, None), (4, "same words again " * 50)]
    df = documents(spark, rows).withColumnRenamed("lang", "kept")
    assert sorted(map(str, keep_quality(df).collect())) == sorted(map(str, df.filter("text = '" + clean + "'").collect()))
    assert keep_quality(documents(spark, [])).count() == 0


def test_very_long_text(spark):
    text = "all the same " * 30_000
    row = repetition_quality(documents(spark, [(1, text)])).first()
    assert (row.n_words, row.n_repeat_words, row.longest_repeat, row.kept) == (90_000, 90_000, 89_997, False)
