import random

from changeloom.llm.components import components
from changeloom.llm.near_dedup import REACH, SYMBOLS, WIDTH, chance_lost, chunk_keys, keep_first, near_duplicates, near_in_keys

from .helpers import corpus, documents, lower, words


def sets(rows, n):
    out = {}
    for i, t in rows:
        w = words(lower(t))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, n, percent):
    s, parent = sets(rows, n), {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i), root(i) == i) for i in ids}


def run(df, n):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, n, 80).collect()}


def test_against_all_pairs(spark):
    rows = corpus(3, 60)
    base = rows[-1][1] or "word " * 30
    chain = " ".join(f"w{k}" for k in range(60)).split()
    for k in range(6):  # each near the next, ends far apart
        chain[k * 3] = f"edit{k}"
        rows.append((100 + k, " ".join(chain)))
    rows += [(200, base), (201, base), (202, base + " more")]
    for n in (2, 5):
        assert run(documents(spark, rows), n) == brute(rows, n, 80)


def test_nulls_repeats_and_empty_tables(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (5, text), (5, text), (3, text), (4, ""), (6, None), (7, "one")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows), 2).collect())
    assert got == [(0, 6, None, True), (3, 6, 3, True), (4, 0, 4, True), (5, 6, 3, False), (5, 6, 3, False), (6, 0, 6, True), (7, 1, 7, True)]
    assert near_duplicates(documents(spark, [])).count() == 0


def test_filter_passes_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = documents(spark, [(1, text), (2, text), (3, "other words here")]).withColumnRenamed("lang", "kept").withColumnRenamed("source", "component_id")
    out = keep_first(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_components_of_a_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_are_hardly_ever_lost(spark):
    assert chance_lost(0.8) < 1e-6 and chance_lost(0.9) < chance_lost(0.8)
    # two signatures 27 symbols apart, two in a chunk where they fit, share a key; REACH apart they are looked at
    one = bytes(SYMBOLS)
    spread, far = bytearray(one), bytearray(one)
    for k in range(27):
        spread[k // 2 * WIDTH + k % 2] = 1
    far[SYMBOLS - 38 :] = b"\1" * 38
    reps = spark.createDataFrame([(1, bytearray(one), 9), (2, spread, 9), (3, far, 9)], "id long, sig binary, n long")
    keys = {}
    for r in chunk_keys(reps).collect():
        keys.setdefault(r.id, set()).add(r.key)
    assert keys[1] & keys[2] and keys[1] & keys[3]
    shared = spark.createDataFrame([(9, 1, 3, k) for k in (1, 2, 3)], "key long, hub long, k long, id long")
    for reach, found in ((REACH, {(2, 1), (3, 1)}), (37, {(2, 1)}), (26, set())):
        assert {(r.a, r.b) for r in near_in_keys(shared, reps, reach, 80, 9).collect()} == found


def alike(rng, shared, apart):
    """Two texts of `shared` common words and `apart` others each in one place."""
    words = [f"w{rng.randrange(10**9)}" for _ in range(shared)]
    cut = rng.randrange(shared)
    return [" ".join(words[:cut] + [f"x{rng.randrange(10**9)}" for _ in range(apart)] + words[cut:]) for _ in range(2)]


def test_all_planted_pairs_are_linked(spark):
    rng, rows = random.Random(4), []
    for k in range(2000):  # similarities from 0.80 to 0.82
        apart = rng.randrange(5, 20)
        one, two = alike(rng, 2 + 8 * (apart + 1) + rng.randrange(-1, apart + 1), apart)
        rows += [(2 * k, one), (2 * k + 1, two)]
    s = sets(rows, 2)
    linked = [k for k in range(2000) if 80 * len(s[2 * k] | s[2 * k + 1]) <= 100 * len(s[2 * k] & s[2 * k + 1])]
    close = [k for k in linked if 100 * len(s[2 * k] & s[2 * k + 1]) <= 82 * len(s[2 * k] | s[2 * k + 1])]
    got = run(documents(spark, rows), 2)
    assert len(close) > 1000 and [k for k in range(2000) if got[2 * k + 1][1] == 2 * k] == linked


def test_families_of_many_blocks(spark):
    """Blocks of a few documents, hubs that hold nothing, lone members."""
    rng, rows = random.Random(8), []
    base = [f"v{k}" for k in range(60)]
    for i in range(120):
        words = base[:]
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 2, 80)
    assert 5 < len({x[1] for x in want.values()}) < 110
    for block, room in ((1024, 400), (8, 400), (8, 1 << 20)):
        got = near_duplicates(documents(spark, rows), 2, 80, block=block, room=room).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == want
