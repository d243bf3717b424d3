"""run() against brute force: the stages' rules on a small fixture."""

import random

import corpus_pipeline
import sentencepiece

from changeloom.llm.piece_fst import PATH

from . import test_decontaminate, test_line_dedup, test_near_dedup, test_repetition
from .helpers import SCHEMA

ITEM = "nine green bottles were standing on the old stone wall when the first of them began to sing a slow song about the sea and the rain"


def fixture(spark, folder):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmnprst" for b in ("a", "en", "ir", "olu", "ut", "Ys")]
    prose = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    footer = "this footer line is the same in many documents"
    rows = [(i, prose(70) + "\n" + prose(30)) for i in range(12)]
    single = prose(120)
    rows += [(60, single), (61, single + " with a tail")]  # near copies
    rows += [(20 + k, rows[k][1] + "\n" + footer) for k in range(4)]  # copies line by line
    rows += [(30, prose(60) + "\n" + ITEM), (31, "too short"), (32, "again and again " * 40), (33, None), (34, "")]
    rows += [(40 + k, prose(80) + "\n" + footer + "\n" + prose(10)) for k in range(3)]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def brute(rows):
    rows = [(i, t) for i, t in rows if test_repetition.brute(t)[6]]
    lines = test_line_dedup.brute(rows)
    rows = [(i, lines[i][2]) for i, _ in rows]
    near = test_near_dedup.brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if near[i][2]]
    held = test_decontaminate.brute(rows, [(1, ITEM)])
    rows = [(i, t) for i, t in rows if not held[i]]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return {i: library.encode(t) for i, t in rows}


def test_run_against_brute_force(spark, tmp_path):
    rows = fixture(spark, str(tmp_path))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = brute(rows)
    assert {i: list(r.ids) for i, r in got.items()} == want
    assert 30 not in got and 31 not in got and 32 not in got and 61 not in got and 0 in got and 60 in got


def test_stages_keep_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'x' AS lines", "1 AS kept", "2 AS `__n`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    assert docs.filter("n_chars <> length(text)").count() == 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
