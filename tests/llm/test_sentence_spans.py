import re

from changeloom.llm.sentence_spans import SENTENCE, dedup_spans

from .helpers import corpus, documents, lower, words


def brute(rows, run, least, alone=40):
    found, parts = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        pieces = re.findall(SENTENCE, t or "")
        parts[i] = pieces
        worded = [(k, words(lower(p))) for k, p in enumerate(pieces) if words(p)]
        for k in range(len(worded)):
            for stop in range(k + 1, len(worded) + 1):  # the shortest run that suffices
                part = worded[k:stop]
                size = sum(len(w) for _, w in part)
                if size >= alone or (len(part) >= min(run, len(worded)) and size >= least):
                    found.setdefault(tuple(tuple(w) for _, w in part), []).append((i, part[0][0], part[-1][0]))
                    break
    gone = {i: set() for i, _ in rows}
    for places in found.values():
        for i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b + 1))
    return {i: (len(p), len(gone[i]), "".join(x for k, x in enumerate(p) if k not in gone[i])) for i, p in parts.items()}


def test_against_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed + 10, 50)
        for run, least, alone in ((3, 8, 40), (2, 3, 6), (2, 20, 40)):
            got = {r.doc_id: (r.spans.n_sentences, r.spans.n_removed, r.spans.text) for r in dedup_spans(documents(spark, rows), run, least, alone).collect()}
            assert got == brute(rows, run, least, alone)


def test_nulls_repeats_and_clashes(spark):
    text = "A first sentence of words. A second one follows it. And a third one."
    rows = [(1, text), (1, text), (2, text + " Own words here."), (None, text), (3, None), (4, "")]
    df = documents(spark, rows).withColumnRenamed("lang", "spans")
    got = sorted(((r.doc_id or 0, r.spans.n_removed, r.spans.text) for r in dedup_spans(df, 3, 8).collect()))
    assert got == [(0, 0, text), (1, 0, text), (1, 0, text), (2, 3, " Own words here."), (3, 0, ""), (4, 0, "")]
    assert dedup_spans(documents(spark, [])).count() == 0


def test_two_long_sentences_and_cut_edges(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(15)) for x in "abcd")
    one = f"Lead in {a}. {b}. {c}. {d} and then on."
    two = f"Other words before {a}. {b}. {c}. {d}, then nothing."
    pair = f"{a}. {b}."
    rows = [(1, one), (2, two), (3, pair), (4, f"Before. {pair} After it."), (5, "Yes. No."), (6, "Yes. No.")]
    got = {r.doc_id: (r.spans.n_removed, r.spans.text) for r in dedup_spans(documents(spark, rows)).collect()}
    assert got[2] == (2, f"Other words before {a}. {d}, then nothing.") and got[4] == (2, "Before. After it.")
    assert [got[i][0] for i in (1, 3, 5, 6)] == [0, 0, 0, 0]


def test_a_sentence_as_long_as_several(spark):
    long = " ".join(f"n{k}" for k in range(45))
    rows = [(1, f"First. {long}. Some more of it."), (2, f"Second, other. {long}. And an end.")]
    got = {r.doc_id: (r.spans.n_removed, r.spans.text) for r in dedup_spans(documents(spark, rows)).collect()}
    assert got == {1: (0, rows[0][1]), 2: (1, "Second, other. And an end.")}
