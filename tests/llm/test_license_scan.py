import random
import re

from changeloom.llm.license_scan import PHRASES, TEMPLATES, Scanner, scan_licenses, words_of

from .helpers import documents, lower

SCANNER = Scanner(TEMPLATES, PHRASES, 3, 5, 0.8)


def test_matching_statistics_against_every_substring():
    auto, rng, known = SCANNER.automaton, random.Random(3), set()
    sequences = [ids for _, ids in auto.templates] + [[auto.vocabulary[w] for w in p.encode().split()] for p in PHRASES]
    for ids in sequences:
        known |= {tuple(ids[a:b]) for a in range(len(ids)) for b in range(a + 1, len(ids) + 1)}
    for _ in range(100):
        ids = [rng.randrange(len(auto.vocabulary)) for _ in range(30)]
        part = rng.choice(sequences)
        at = rng.randrange(len(part))
        ids[5:5] = part[at : at + 10]
        for k, (_, size) in enumerate(auto.stream(ids)):
            assert size == max(n for n in range(k + 2) if not n or tuple(ids[k + 1 - n : k + 1]) in known)


def test_base_phrases_against_search():
    rng = random.Random(2)
    choice = "gnu general public license apache cc by mit version licensed under the x".split()
    for _ in range(1000):
        ws = [rng.choice(choice) for _ in range(rng.randint(0, 40))]
        base, _ = SCANNER.scan([w.encode() for w in ws])
        assert sorted(base) == sorted((i, k) for k, p in enumerate(PHRASES) for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())


def test_words():
    text = "Ünder the MIT-License, v2.0\x7f(c) é_x"
    assert [w.decode() for w in words_of(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_labels_and_spans(spark):
    rows = [
        (1, "some text. Licensed under CC BY-NC 4.0."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and its documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
        (4, "the license of the public is general"),
        (5, None),
        (None, ""),
        (6, "mit license " * 3),
    ]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows)).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].score) == ("cc-by", "cc-by,cc-by-nc-4.0", 1.0)
    assert "gpl" in got[2].base_labels and "gpl-3" in got[2].labels.split(",")
    assert got[3].n_base == 0 and got[3].labels == "mit-notice" and 0.8 <= got[3].score < 1
    assert (got[4].n_base, got[4].labels, got[4].first_word) == (0, "", None)
    assert (got[5].n_words, got[5].score, got[None].n_words) == (0, 0.0, 0)
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].n_words) == (3, 0, 4, 6)
    assert scan_licenses(documents(spark, [])).count() == 0


def slow_matches(ids):
    """The matches of three words or more that go on neither way, of each
    template on its own."""
    out = []
    for t, (_, own) in enumerate(SCANNER.automaton.templates):
        table = {}
        for i, x in enumerate(ids):
            for j, y in enumerate(own):
                if x == y:
                    table[i, j] = table.get((i - 1, j - 1), 0) + 1
        out += [(i + 1, n, t, j + 1) for (i, j), n in table.items() if n >= 3 and (i + 1, j + 1) not in table]
    return out


def slow_chains(matches):
    """The best chain of each template over all earlier matches."""
    placed, out = {}, {}
    for end, size, t, template_end in matches:
        placed.setdefault(t, []).append((end, size, template_end))
    for t, found in placed.items():
        total, best, done = len(SCANNER.automaton.templates[t][1]), (0.0, 0, 0), []
        for end, size, stop in found:
            covered, first = size, end - size
            for e, s, c, f in done:
                more = min(size, end - e, stop - s)
                if more > 0 and end - size - e <= 5 and stop - size - s <= 5 and c + more > covered:
                    covered, first = c + more, f
            done.append((end, stop, covered, first))
            if covered / total > best[0]:
                best = (min(1.0, covered / total), first, end)
        out[t] = best
    return out


def test_chains_against_all_pairs_of_matches():
    rng, auto = random.Random(5), SCANNER.automaton
    words = {i: w for w, i in auto.vocabulary.items()}
    some = 0
    for _ in range(150):
        text = []
        for _ in range(3):
            part = [words[i] for i in rng.choice(auto.templates)[1]]
            for _ in range(rng.randrange(6)):
                part[rng.randrange(len(part))] = rng.choice([b"other", b"software", b"the"])
            text += part[rng.randrange(5) :] + [b"x"] * rng.randrange(8)
        seen = []
        keep = SCANNER.chains
        SCANNER.chains = lambda m, seen=seen: seen.extend(m) or keep(m)
        _, got = SCANNER.scan(text)
        del SCANNER.chains
        assert sorted(seen) == sorted(slow_matches([auto.vocabulary.get(w, -1) for w in text]))
        assert got == (slow_chains(seen) if seen else {})
        some += len(got)
    assert some > 300


def test_whole_licences_and_one_word_phrases(spark, tmp_path):
    from changeloom.llm.license_scan import read_templates

    (tmp_path / "Own-1.0.txt").write_text("You may look at it, but never touch it; ask first.")
    more = read_templates(spark, str(tmp_path))
    isc = TEMPLATES["isc"][0].replace("the author", "a b c", 1)
    rows = [(1, "Copyright x. " + isc), (2, TEMPLATES["bsd-3-clause"][0]), (3, "you may look at it but never touch it ask first"), (4, "wtfpl"), (5, "see WTFPL!")]
    got = {r.doc_id: r for r in scan_licenses(documents(spark, rows), TEMPLATES | more, PHRASES | {"wtfpl": "wtfpl"}).collect()}
    assert got[1].labels == "isc" and {"bsd", "bsd-3-clause"} <= set(got[2].labels.split(",")) and got[3].labels == "own-1.0"
    assert (got[4].base_labels, got[4].first_word, got[5].first_word) == ("wtfpl", 0, 1)
