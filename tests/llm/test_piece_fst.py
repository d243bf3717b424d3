import random
import re

import pytest
import sentencepiece

from changeloom.llm.piece_fst import PATH, PieceTransducer, compiled, decode_pieces, encode_pieces, load

from .helpers import corpus, documents


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(1)
    yield from ["", " ", "   ", " " * 40 + "a", "a" + " " * 33, "\n\n", "a\n b", "▁x", "x\x00y", "日本語のテキスト", "😀😀 a", "0123  456", "<s> </s> <0x41>", "return   x;\n        if (a) {\n"]
    for _ in range(400):
        yield "".join(rng.choice(" ab the12\n_é(){};=日") for _ in range(rng.randint(1, 80)))
        yield "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x500), rng.randint(0x3000, 0xD000)])) for _ in range(rng.randint(1, 60)))


def test_as_the_library_encodes_and_decodes(library):
    fst = compiled(load())
    for text in odd_texts():
        ids = library.encode(text)
        assert fst.encode(text) == ids
        assert fst.decode(ids) == library.decode(ids)


def test_unigram_weights_against_every_path(library):
    """As a unigram model, the path is the cheapest of all segmentations."""
    fst = PieceTransducer(load(), PieceTransducer.UNIGRAM)

    def cheapest(s):
        if not s:
            return 0.0
        costs = [cheapest(s[k:]) - fst.scores[fst.id_of[s[:k]]] for k in range(1, len(s) + 1) if s[:k] in fst.id_of]
        return min(costs)

    for word in ("▁the", "▁tension", "▁rebat", "▁niño"):
        assert sum(-fst.scores[i] for i in fst.shortest(word)) == pytest.approx(cheapest(word))


def test_normaliser_against_its_definition():
    """The machine's one path against string functions, with and without squeezing."""
    for squeeze in (True, False):
        for dummy in (True, False):
            field = lambda n, v: bytes([n << 3, v])
            norm = field(3, dummy) + field(4, squeeze)
            fst = PieceTransducer(load() + bytes([3 << 3 | 2, len(norm)]) + norm)
            assert (fst.squeeze, fst.dummy) == (squeeze, dummy)
            for text in odd_texts():
                want = re.sub(" +", " ", text.strip(" ")) if squeeze else text
                assert fst.normalise(text) == (("▁" if dummy else "") + want.replace(" ", "▁") if want else "")


def test_fallback_is_an_arc(library):
    """A character without a piece is rewritten on the path, whatever stands around it."""
    fst = PieceTransducer(load(), PieceTransducer.UNIGRAM)
    odd = next(c for c in map(chr, range(0xA000, 0xB000)) if c not in fst.id_of)
    ids = fst.shortest("▁the" + odd + "the")
    assert ids == [*fst.shortest("▁the"), *(fst.byte[b] for b in odd.encode()), *fst.shortest("the")]
    assert fst.decode(ids) == "the" + odd + "the"


def test_round_trip_on_tables(spark, library):
    rows = corpus(2) + [(None, "no id"), (7, "again"), (7, "again")]
    encoded = encode_pieces(documents(spark, rows))
    got = encoded.collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in got) == sorted((i or -1, library.encode(t or "")) for i, t in rows)
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
    back = decode_pieces(encoded.select("doc_id", "ids"))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t or "") for i, t in rows)
    assert encode_pieces(documents(spark, [])).count() == 0


def test_very_long_text(library):
    text = "ñandú " * 50_000 + "x" * 20_000
    fst = compiled(load())
    assert fst.encode(text) == library.encode(text)
