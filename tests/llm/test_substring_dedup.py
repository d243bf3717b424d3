import hashlib
import random
from collections import Counter

import numpy as np

from changeloom.llm import anchors
from changeloom.llm.substring_dedup import _sorted_buckets, dedup_substrings, repeated_suffixes

from .helpers import documents


def brute(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[k : k + width] for _, t in texts for k in range(len(t) - width + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        edges = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(t), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(df, **options):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in dedup_substrings(df, **options).collect())


def passages(seed):
    rng = random.Random(seed)
    prose = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    shared = [prose(k) for k in (59, 60, 61, 90, 200)]
    rows = []
    for i in range(40):
        text = prose(rng.randrange(150))
        for _ in range(rng.randrange(3)):
            text += rng.choice(shared) + prose(rng.randrange(80))
        rows.append((i, rng.choice([text, text, text, "", None]) if rng.random() < 0.3 else text))
    return rows + [(100, "x" * 500), (101, "xy" * 45), (102, rows[0][1]), (103, rows[0][1])]


def test_against_brute_force(spark):
    for seed in range(2):
        rows = passages(seed)
        assert run(documents(spark, rows), width=60) == brute(rows, 60)


def test_many_runs_at_one_anchor_over_small_buckets(spark):
    rng = random.Random(8)
    prose = lambda k: "".join(rng.choice("abcdef ") for _ in range(k))
    passage = prose(80)
    rows = [(i, prose(rng.randrange(60, 90)) + passage + prose(rng.randrange(60, 90))) for i in range(40)]
    assert run(documents(spark, rows), width=60, bucket=3) == brute(rows, 60)


def test_a_batch_of_copied_runs_tells_its_windows(spark):
    rng = random.Random(8)
    prose = lambda k: bytes(rng.choice(b"abcdef ") for _ in range(k))
    common = prose(70)
    kinds = "lead long, anchor long, bucket int, shared boolean, doc_id long, tid long, start int, known boolean, bytes binary, place int"
    copied, lone = prose(12) + common, prose(10) + common
    opened = spark.createDataFrame([(1, 1, 0, True, 1, 1, 0, True, copied, 22), (1, 1, 1, True, 2, 2, 0, False, lone, 20)], kinds)
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}  # so that the two buckets are two batches
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        rows = _sorted_buckets(opened, 60).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    told = {(r.g1, r.g2, w.f1, w.f2) for r in rows if r.doc_id is None for w in r.windows}
    asked = {w.a: (r.g1, r.g2, w.f1, w.f2) for r in rows if r.doc_id == 2 for w in r.windows}
    assert {a for a, key in asked.items() if key in told} == set(range(10, 21))


def test_nulls_repeats_and_empty_tables(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(300))
    got = [(r.doc_id, r.n_removed) for r in dedup_substrings(documents(spark, [(1, text), (1, text), (None, text), (2, None)]), width=200).collect()]
    assert sorted(got, key=str) == [(1, 300), (1, 300), (2, 0), (None, 0)]
    assert dedup_substrings(documents(spark, [])).count() == 0


def test_multikey_sort_against_a_set():
    rng = random.Random(2)
    data = bytes(rng.choice(b"ab") for _ in range(400))
    at, group = np.arange(380), np.array([rng.randrange(3) for _ in range(380)])
    seen = Counter((g, data[a : a + 13]) for a, g in zip(at.tolist(), group.tolist()))
    assert repeated_suffixes(data, at, group, 13).tolist() == [seen[g, data[a : a + 13]] > 1 for a, g in zip(at.tolist(), group.tolist())]


def test_anchors_of_a_text_longer_than_a_block(monkeypatch):
    data = np.random.default_rng(3).integers(97, 103, 9000).astype(np.uint8)
    starts = np.array([0, 7000, 9000])
    whole = anchors.runs(data, starts, 200)
    monkeypatch.setattr(anchors, "BITS", 10)
    assert all((x == y).all() for x, y in zip(whole, anchors.runs(data, starts, 200), strict=True))
    places = anchors.rolling(data, anchors.PART)
    for first, _, place, anchor in zip(*whole, strict=True):
        assert first <= place <= first + 150 and anchor == places[first : first + 151].min()
