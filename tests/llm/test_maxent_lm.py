import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from changeloom.llm import maxent_lm as M
from changeloom.llm.maxent_lm import score_texts

from .helpers import corpus, documents, lower, words


def tokens(text):
    return [*words(lower(text)), "\n"]


def brute(rows):
    train = Counter(w for i, t in rows if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return n, {i: (zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2, len(tokens(t)), sum(w in train for w in tokens(t)), sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("head", [1 << 18, 10, 0])
def test_base_against_brute_force(spark, head):
    rows = corpus(6, 40) + [(None, "no id here"), (90, "same Words"), (90, "same Words")]
    n, want = brute(rows)
    got = score_texts(documents(spark, rows), head_words=head).collect()
    assert len(got) == len(rows)
    for r in got:
        held, size, known, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, size, known, n)
        assert r.base_score == pytest.approx(base) and math.isfinite(r.score) and r.score < 0


def test_model_beats_base_on_held_out_text(spark):
    rng = random.Random(3)
    follow = {w: rng.sample("abcdefghijklmnopqrstuvwxyz", 2) for w in "abcdefghijklmnopqrstuvwxyz"}

    def text():
        out = ["a"]
        for _ in range(150):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    got = score_texts(documents(spark, [(k, text()) for k in range(200)])).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def tiny_head():
    head = M.Head([(f"w{k}", 40 - k) for k in range(30)], 900, 33)
    head.shares({(M.SINGLES + M.BINS) * M.GROUPS + 7: 5})
    return head


def test_shares_sum_to_one():
    head = tiny_head()
    assert head.share.sum() == pytest.approx((sum(40 - k + 1 for k in range(30)) + 5 + 1) / 934) and head.inner.sum(axis=1) == pytest.approx(1)


def slow_trainer(texts_, head, rate, shrink):
    """The model of one shard, token by token in dictionaries: a function of a
    text that gives its gain."""
    inner, share = head.inner, head.share

    def tokens_of(text):
        codes = [head.words.get(w, M._rare_code(w)) for w in [*(text or "").lower().encode().split(), M.END]]
        leaves = [int(head.leaves_of(np.array([c], np.uint32))[0]) for c in codes]
        features = M._features(np.array(codes, np.uint32), np.array([0, len(codes)]), np.array(leaves), M.ROWS)
        for k, leaf in enumerate(leaves):
            c, g = divmod(leaf, M.GROUPS)
            yield 0, [int(features[0][t][k]) for t in range(3)], np.log(share), c
            if c >= M.SINGLES:
                yield 1, [int(features[1][t][k]) for t in range(3)], np.log(inner[c]), g

    w, squares, seen = {}, Counter(), Counter()
    zero = np.zeros(M.CLASSES)

    def probabilities(level, rows, bias):
        x = np.exp(sum((w.get((level, t, r), zero) for t, r in enumerate(rows)), bias))
        return x / x.sum()

    every = [x for text in texts_ for x in tokens_of(text)]
    for level in (0, 1):
        own = [x for x in every if x[0] == level]
        assert len(own) <= M.BATCH  # one step
        total = {}
        for _, rows, bias, chosen in own:
            error = probabilities(level, rows, bias)
            error[chosen] -= 1
            for t, r in enumerate(rows):
                seen[level, t, r] += 1
                total[level, t, r] = total.get((level, t, r), zero) + error
        for key, x in total.items():
            squares[key] += (x * x).sum() / M.CLASSES
            w[key] = w.get(key, zero) - x * rate / math.sqrt(squares[key] + 1e-3)
    for key in w:
        w[key] = w[key] * seen[key] / (seen[key] + shrink)
    return lambda text: sum(math.log10(probabilities(level, rows, bias)[chosen]) - bias[chosen] / math.log(10) for level, rows, bias, chosen in tokens_of(text))


def test_score_against_a_slow_trainer(spark):
    rows = [(i, t) for i, t in corpus(5, 30) if i not in (3, 4)] + [(90, "same Words"), (91, None)]
    got = score_texts(documents(spark, rows), head_words=60).collect()
    training = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for _, t in training for w in tokens(t))
    table = spark.createDataFrame(list(counts.items()), "word string, c long")
    head = M.find_head(table, 60)
    assert 0 < len(head.words) < len(counts)
    gain = slow_trainer([t for _, t in training], head, 0.1, 20.0)
    texts_ = dict(rows)
    for r in got:
        assert r.score - r.base_score == pytest.approx(gain(texts_[r.doc_id]), rel=0.01, abs=0.01)


def test_model_does_not_depend_on_the_cluster(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS", 16)  # several shards
    rows = [(i, t) for i, t in corpus(7, 1500)]
    df = documents(spark, rows)
    one = {r.doc_id: r.score for r in score_texts(df.coalesce(1), most_rows=16).collect()}
    two = {r.doc_id: r.score for r in score_texts(df.repartition(7), most_rows=16).collect()}
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], rel=1e-5) for i in one)


def test_rows_grow_with_the_tokens():
    assert [M.model_rows(n, 1 << 20) for n in (0, 1 << 24, (1 << 26) - 1, 1 << 26, 1 << 32, 1 << 60)] == [1 << 13, 1 << 13, 1 << 13, 1 << 14, 1 << 17, 1 << 20]


def test_empty_table(spark):
    assert score_texts(documents(spark, [])).count() == 0
    only = score_texts(documents(spark, [(k, "held out alone") for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2])).collect()
    assert only and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in only)
