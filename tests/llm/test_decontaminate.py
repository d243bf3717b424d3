import random
import re
from collections import Counter

import numpy as np

from changeloom.llm.decontaminate import GAP, MATCH, MISS, align, drop_contaminated, find_contamination

from .helpers import documents

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards brew a strange potion near the old river bank at night"


def items(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def brute_align(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISS), table[i - 1][j] + GAP, table[i][j - 1] + GAP)
    return max(max(r) for r in table)


def test_alignment_against_the_plain_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 15))] for _ in range(2))
        score, end_a, end_b = align(np.array(a), np.array(b))
        assert score == brute_align(a, b) and score == brute_align(a[:end_a], b[:end_b])


def test_exact_edited_and_clean(spark):
    noise = " ".join(f"n{k}" for k in range(200))
    edited = ITEM.replace("lazy", "sleepy").replace("seven wizards", "some seven wizards").replace("near", "by")
    rows = [(1, f"{noise}. {ITEM.upper()}! {noise}"), (2, f"{noise} {edited} {noise}"), (3, noise), (4, "the quick brown fox is a phrase. " + noise), (5, None), (6, ""), (None, ITEM)]
    got = {r.doc_id: r for r in find_contamination(documents(spark, rows), items(spark, (9, ITEM), (8, "unrelated text of some other test item"), (7, None), (6, ""))).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, None}
    assert got[1].best_score == 1.0 and got[1].item_ids == [9] and 0.7 < got[2].best_score < 1.0
    assert got[1].hits[0].first_word == 200 and got[1].hits[0].end_word == 200 + len(ITEM.split())
    assert sorted(r.doc_id for r in drop_contaminated(documents(spark, rows), items(spark, (9, ITEM))).collect()) == [3, 4, 5, 6]


def test_excerpts_of_long_items(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(400)}" for _ in range(700)]
    noise = [f"n{k}" for k in range(60)]
    around = lambda part: " ".join([*noise, *part, *noise])
    edited = item[200:230]
    edited[10], edited[20:21] = "other", ["two", "words"]
    scattered = [w for k in range(300, 390, 9) for w in (*item[k : k + 6], "x", "y", "z")]
    rows = [(1, around(item[100:400])), (2, around(item[600:690])), (3, around(item[50:63])), (4, around(edited)), (5, around(item[50:61])), (6, around(scattered)), (7, around([]))]
    table = items(spark, (1, " ".join(item)), (2, " ".join(item[500:])))
    got = {r.doc_id: r for r in find_contamination(documents(spark, rows), table).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {1, 2, 3, 4}
    assert 0.4 < got[1].best_score < 0.5 and got[2].item_ids == [1, 2]
    assert sorted(r.doc_id for r in drop_contaminated(documents(spark, rows), table).collect()) == [5, 6, 7]


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) for _ in range(20)) for _ in range(12)]
    rows = [(k, " ".join(f"x{j}" for j in range(30)) + " " + t) for k, t in enumerate(texts)] + [(50, texts[0]), (50, texts[0])]
    table = items(spark, *enumerate(texts))
    one = find_contamination(documents(spark, rows), table)
    many = find_contamination(documents(spark, rows), table, block_words=50)
    key = lambda df: sorted((r.doc_id, r.contaminated, r.best_score, tuple(r.item_ids)) for r in df.collect())
    assert key(one) == key(many) and all(r[1] for r in key(one))


def test_short_items_and_empty_tables(spark):
    got = find_contamination(documents(spark, [(1, "it was forty two indeed"), (2, "forty one")]), items(spark, (1, "forty two")))
    assert {r.doc_id: r.contaminated for r in got.collect()} == {1: True, 2: False}
    assert find_contamination(documents(spark, []), items(spark, (1, ITEM))).count() == 0
    assert not find_contamination(documents(spark, [(1, ITEM)]), items(spark)).first().contaminated


def table_score(a, b, match, miss, gap):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (match if x == y else miss), row[j + 1] + gap, new[j] + gap))
        row, best = new, max(best, *new)
    return best


def brute(rows, benchmark, n=4, max_items=3, least=0.5):
    """Every document against every item that it shares a seed with, whole."""
    word = re.compile(r"[^\W_]+")
    split = lambda t: word.findall((t or "").lower())
    grams = lambda w: {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))}
    table = [(i, split(t)) for i, t in benchmark if split(t)]
    held = Counter(g for _, w in table for g in grams(w))
    out = {}
    for d, text in rows:
        ws, out[d] = split(text), {}
        for i, w in table:
            seeds = {g for g in grams(w) if held[g] <= max_items} or grams(w)
            if not any(tuple(ws[k : k + len(g)]) == g for g in seeds for k in range(len(ws))):
                continue
            share = table_score(w, ws, 2, -1, -1) / (2 * len(w))
            if share >= least or table_score(w, ws, 1, -3, -3) >= 13:
                out[d][i] = share
    return out


def test_result_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("a", "en", "ir", "o", "ut")]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    benchmark = [(i, prose(rng.choice((3, 12, 25, 60)))) for i in range(12)]
    benchmark += [(20 + k, benchmark[3][1][:10] + prose(6)) for k in range(4)]
    rows = []
    for d in range(60):
        part = rng.choice(benchmark)[1]
        a, b = sorted((rng.randrange(len(part) + 1), rng.randrange(len(part) + 1)))
        part = part[a:b] if rng.random() < 0.5 else part[:]
        for _ in range(rng.randrange(5)):
            if part:
                at = rng.randrange(len(part))
                part[at : at + rng.randrange(2)] = prose(rng.randrange(3))
        rows.append((d, " ".join([*prose(rng.randrange(60)), *part, *prose(rng.randrange(60))])))
    benchmark = [(i, " ".join(w)) for i, w in benchmark]
    want = brute(rows, benchmark)
    got = {r.doc_id: {h.item_id: h.score for h in r.hits} for r in find_contamination(documents(spark, rows), items(spark, *benchmark)).collect()}
    assert got == want and 10 < sum(map(bool, want.values())) < 60
