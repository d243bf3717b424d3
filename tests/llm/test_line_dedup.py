import hashlib

from changeloom.llm.line_dedup import dedup_lines, dropped_lines

from .helpers import corpus, documents, lower


def brute(rows, min_docs=2):
    key = lambda line: lower(line).strip(" \t\n\x0b\x0c\r")
    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) >= min_docs and min(holders[key(x)]) != doc_id)]
        out[doc_id] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def run(df):
    return {r.doc_id: (r.lines.n_lines, r.lines.n_dropped, r.lines.text) for r in dedup_lines(df).collect()}


def test_against_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed)
        assert run(documents(spark, rows)) == brute(rows)


def test_blanks_case_and_length(spark):
    rows = [(1, "\tAn Equal LINE \r\nshort\n0123456789"), (2, "an equal line\nshort\n0123456789\x0b"), (3, "é123456789\nÉ123456789"), (4, "É123456789 \n123456789")]
    assert run(documents(spark, rows)) == brute(rows)


def test_threshold(spark):
    rows = [(1, "a line of three"), (2, "a line of three"), (3, "a line of three\nof two only"), (4, "of two only")]
    got = {r.doc_id: set(r.drop) for r in dropped_lines(documents(spark, rows).select("doc_id", "text"), min_docs=3).collect()}
    assert got == {2: {0}, 3: {0}}


def test_nulls_repeats_and_clashes(spark):
    rows = [(None, "a line that two share"), (1, "a line that two share"), (1, "a line that two share"), (2, None), (3, "")]
    df = documents(spark, rows).withColumnRenamed("lang", "lines").withColumnRenamed("source", "pos")
    got = sorted((r.doc_id or 0, r.lines.n_lines, r.lines.n_dropped, r.lines.text) for r in dedup_lines(df).collect())
    assert got == [(0, 1, 0, "a line that two share"), (1, 1, 0, "a line that two share"), (1, 1, 0, "a line that two share"), (2, 1, 0, ""), (3, 1, 0, "")]
    assert dedup_lines(documents(spark, [])).count() == 0


def test_long_text(spark):
    text = "\n".join(f"line number {i}" for i in range(50_000))
    got = run(documents(spark, [(1, text), (2, text)]))
    assert got[1] == (50_000, 0, text) and got[2] == (50_000, 50_000, "")
    assert hashlib.sha256(got[2][2].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
