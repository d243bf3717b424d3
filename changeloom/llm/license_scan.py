"""License scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the template texts and base phrases.
Streaming a file through it gives, at each word, the longest suffix of what was
read that some template contains (matching statistics). Maximal matches of
enough words are chained, per template, into covered spans. The templates are a
fixed, small list, so the automaton is built once in each worker; no shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm.common import blobs, over_texts, texts

#: Base phrases and their labels (fixed by the contract).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_MIT_BODY = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
    "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)
_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_SOURCE = "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
_BSD_BINARY = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_NAME = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)


def _gnu(license: str) -> list[str]:
    """The two paragraphs by which a GNU licence is applied."""
    return [
        f"this program is free software you can redistribute it and or modify it under the terms of the {license} as published by the free software foundation",
        f"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {license} for more details",
    ]


#: Template texts by label: whole short licences, and of long ones the notices by
#: which they are applied or recognised (fixed values). `read_templates` adds more.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl-3": ["released under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-notice": _gnu("gnu general public license"),
    "lgpl-notice": _gnu("gnu lesser general public license"),
    "agpl-notice": _gnu("gnu affero general public license"),
    "mit-notice": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "mit": [f"{_MIT_BODY} {_MIT_DISCLAIMER}"],
    "cc-by-4.0": ["licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc-4.0": ["licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"],
    "cc-by-sa-4.0": ["licensed under cc by sa 4.0", "licensed under a creative commons attribution sharealike 4.0 international license"],
    "cc0-1.0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "bsd": [_BSD_GRANT, _BSD_SOURCE],
    "bsd-2-clause": [" ".join((_BSD_GRANT, "1", _BSD_SOURCE, "2", _BSD_BINARY, _BSD_DISCLAIMER))],
    "bsd-3-clause": [" ".join((_BSD_GRANT, "1", _BSD_SOURCE, "2", _BSD_BINARY, "3", _BSD_NAME, _BSD_DISCLAIMER))],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution"
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0"],
    "epl-2.0": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "cddl-1.0": ["the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license"],
    "all-rights-reserved": ["all rights reserved"],
}

#: Each byte that is no word byte becomes a blank, and A-Z lower case: the words
#: are then `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class TemplateAutomaton:
    """Generalised suffix automaton over word ids."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        self.vocabulary: dict[bytes, int] = {}
        self.next, self.link, self.length = [{}], [-1], [0]
        self.templates: list[tuple[str, list[int]]] = []
        self.phrase_labels = list(phrases.values())
        self.shortest = min((len(words_of(p.encode())) for p in phrases), default=2)
        coded = [(None, p, k) for k, p in enumerate(phrases)] + [(label, t, -1) for label, ts in templates.items() for t in ts]
        sequences = []
        for label, text, _ in coded:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text.encode())]
            sequences.append(ids)
            last = 0
            for c in ids:
                last = self._extend(last, c)
            if label is not None:
                self.templates.append((label, ids))
        # occurrences: end positions of each state in each template (template texts are short)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for t, (_, ids) in enumerate(self.templates):
            state = 0
            for k, c in enumerate(ids):
                state = self.next[state][c]
                at = state
                while at > 0:
                    self.ends[at].append((t, k + 1))
                    at = self.link[at]
        # all occurrences of a match or of its shorter endings: (template, end, length), no length for the match itself
        self.places: list[list[tuple[int, int, int | None]]] = []
        for state in range(len(self.next)):
            found, seen, at = [], set(), state
            while at > 0:
                found += [(t, e, None if at == state else self.length[at]) for t, e in self.ends[at] if (t, e) not in seen]
                seen.update(self.ends[at])
                at = self.link[at]
            self.places.append(found)
        # phrases that end at a state: (length, phrase), where the match is as long
        own: dict[int, list[tuple[int, int]]] = {}
        for ids, (label, _, k) in zip(sequences, coded, strict=True):
            if label is None:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                own.setdefault(state, []).append((len(ids), k))
        self.phrases: list[list[tuple[int, int]]] = []
        for state in range(len(self.next)):
            found, at = [], state
            while at > 0:
                found += own.get(at, [])
                at = self.link[at]
            self.phrases.append(found)

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:  # generalised: the substring is there already
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def stream(self, ids: list[int], state: int = 0, size: int = 0):
        """(state, matched length) after each word."""
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            yield state, size


class Scanner:
    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], min_match: int, max_gap: int, min_cover: float):
        self.automaton = TemplateAutomaton(templates, phrases)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, tuple[float, int, int]]]:
        """Base places (start, phrase); for each template its best chain
        (coverage, first word, end word)."""
        auto = self.automaton
        ids = np.fromiter((auto.vocabulary.get(w, -1) for w in words), np.int32, len(words))
        known = np.flatnonzero(ids >= 0)
        base: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int, int]] = []  # maximal matches: (end, length, template, end in it)
        if len(known):
            # words outside the vocabulary reset the automaton: only runs of known words are streamed
            cuts = np.flatnonzero(np.diff(known) > 1) + 1
            for run in np.split(known, cuts) if len(cuts) else [known]:
                if len(run) < min(self.automaton.shortest, self.min_match):
                    continue
                start = int(run[0])
                states = list(auto.stream(ids[start : start + len(run)].tolist()))
                for k, (state, size) in enumerate(states):
                    for length, phrase in auto.phrases[state]:
                        if size >= length:
                            base.append((start + k + 1 - length, phrase))
                    if size >= self.min_match:
                        follows = int(ids[start + k + 1]) if k + 1 < len(states) else -1
                        for t, at, length in auto.places[state]:
                            length, template = length or size, auto.templates[t][1]
                            if length >= self.min_match and (at == len(template) or template[at] != follows):
                                matches.append((start + k + 1, length, t, at))
        return base, self.chains(matches) if matches else {}

    def chains(self, matches: list[tuple[int, int, int, int]]) -> dict[int, tuple[float, int, int]]:
        """Chain matches that go forward both in the file and in the template,
        with gaps of max_gap words or fewer."""
        placed: dict[int, list[tuple[int, int, int]]] = {}  # template -> (file end, length, template end)
        for end, size, t, template_end in matches:
            placed.setdefault(t, []).append((end, size, template_end))
        out = {}
        for t, found in placed.items():
            total = len(self.automaton.templates[t][1])
            open_chains: list[tuple[int, int, int, int]] = []  # file end, template end, covered, first word
            best = (0.0, 0, 0)
            later = np.minimum.accumulate([end - size for end, size, _ in reversed(found)])[::-1].tolist()  # the first start still to come
            for (end, size, template_end), start in zip(found, later, strict=True):
                option = (end, template_end, size, end - size)
                open_chains = [c for c in open_chains if start - c[0] <= self.max_gap]
                for before, template_before, covered, first in open_chains:
                    fresh = min(size, end - before, template_end - template_before)
                    if fresh > 0 and end - size - before <= self.max_gap and template_end - size - template_before <= self.max_gap and covered + fresh > option[2]:
                        option = (end, template_end, covered + fresh, first)
                open_chains.append(option)
                if option[2] / total > best[0]:
                    best = (min(1.0, option[2] / total), option[3], end)
            out[t] = best
        return out


_SCANNERS: dict = {}


def read_templates(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Further templates, one text file each, labelled by the file's name without
    its ending. They travel with the plan, so they may hold 4 MB together."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if (files.agg(F.sum("length")).first()[0] or 0) > 4 << 20:
        raise ValueError("templates hold more than 4 MB")
    named = sorted((r.path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower(), bytes(r.content).decode("utf-8", "replace")) for r in files.collect())
    return {label: [text] for label, text in named}


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 3,
    max_gap: int = 5,
    min_cover: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, spans (array of label, first word,
    end word, coverage).

    A template counts where chained matches of min_match words or more, at most
    max_gap words apart, cover min_cover of it; score is the best coverage of
    any template, 1 where a base phrase stands whole. Defined cases: a null or
    empty text has no words, labels '' and score 0; repeated rows give repeated
    rows; texts of any length are streamed whole."""
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    key = repr((templates, phrases, min_match, max_gap, min_cover))

    def work(batch: pa.RecordBatch) -> dict:
        scanner = _SCANNERS.get(key)
        if scanner is None:
            scanner = _SCANNERS[key] = Scanner(templates, phrases, min_match, max_gap, min_cover)
        names = [label for label, _ in scanner.automaton.templates]
        phrase_labels = scanner.automaton.phrase_labels
        rows = []
        for text in blobs(batch):
            words = words_of(text)
            base, found = scanner.scan(words)
            own = sorted({phrase_labels[p] for _, p in base})
            spans = [{"label": names[t], "first_word": a, "end_word": b, "coverage": c} for t, (c, a, b) in sorted(found.items()) if c >= min_cover]
            starts = [s for s, _ in base]
            rows.append(
                {
                    "n_words": len(words),
                    "n_base": len(base),
                    "first_word": min(starts, default=None),
                    "last_word": max(starts, default=None),
                    "base_labels": ",".join(own),
                    "labels": ",".join(sorted({*own, *(s["label"] for s in spans)})),
                    "score": 1.0 if base else max((c for c, _, _ in found.values()), default=0.0),
                    "spans": spans,
                }
            )
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("coverage", pa.float64())]))
        kinds = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)]
        return {"doc_id": batch.column(0)} | {name: pa.array([r[name] for r in rows], kind) for name, kind in kinds}

    return over_texts(
        texts(docs, id_col, text_col),
        work,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,first_word:long,end_word:long,coverage:double>>",
    )
