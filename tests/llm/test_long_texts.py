"""Very long texts through the operators whose own tests hold short ones."""

import random

import pytest

from changeloom.llm.decontaminate import find_contamination
from changeloom.llm.license_scan import scan_licenses
from changeloom.llm.maxent_lm import score_texts
from changeloom.llm.near_dedup import near_duplicates
from changeloom.llm.sentence_spans import dedup_spans
from changeloom.llm.substring_dedup import dedup_substrings

from .helpers import documents

PASSAGE = "a rather rare passage of the test set that nobody would write twice by chance in any prose of theirs"


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(2000)) + rng.choice(["", "", "", "."]) for _ in range(60_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return documents(spark, [(1, long_text), (2, long_text + " tail"), (3, long_text[:200_000] + " " + PASSAGE + " mit license " + long_text[200_000:]), (4, "x" * 300_000)]).cache()


def test_near_duplicates(docs):
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_substrings(docs, long_text):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in dedup_substrings(docs).collect()}
    assert got[1] == (len(long_text), len(long_text), 1) and got[2] == (len(long_text) + 5, len(long_text), 1)
    assert got[3][1] == len(long_text) and got[3][2] == 2 and got[4] == (300_000, 300_000, 1)


def test_spans(docs):
    got = {r.doc_id: r.spans for r in dedup_spans(docs, min_words=1).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed >= got[2].n_sentences - 2 and PASSAGE in got[3].text


def test_scores(docs):
    got = {r.doc_id: r for r in score_texts(docs).collect()}
    assert got[1].n_tokens == 60_001 and got[4].n_tokens == 2 and all(r.score < 0 for r in got.values())


def test_licenses_and_contamination(spark, docs):
    assert {r.doc_id: r.n_base for r in scan_licenses(docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 0}
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in find_contamination(docs, items).collect()} == {1: False, 2: False, 3: True, 4: False}


def test_pieces(docs, long_text):
    import sentencepiece

    from changeloom.llm.piece_fst import PATH, encode_pieces

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {r.doc_id: list(r.ids) for r in encode_pieces(docs).collect()}
    assert got[1] == library.encode(long_text) and got[4] == library.encode("x" * 300_000)
