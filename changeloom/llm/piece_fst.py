"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blanks become
U+2581 or are squeezed, a dummy prefix), the pieces (a trie over characters whose
final arcs carry a piece and its weight) and byte fallback (an arc that rewrites a
character outside the vocabulary to its UTF-8 byte pieces). Each input is composed
with them, states being expanded as the search reaches them, and the output of the
tropical-semiring shortest path is the encoding. One search serves both model types.

Weights. In a unigram model an arc costs minus the piece's log probability. A
BPE model has no additive score: its merges are reproduced by one more acceptor
over neighbouring pieces, which costs 0 where the two pieces are the encoding of
their own concatenation and infinity elsewhere; the path of finite cost is
unique and is what the merges yield.

No piece has a U+2581 behind another character, so a piece boundary is certain
before each run of blanks and around characters that no longer piece uses.
Paths are found between these cuts, and equal stretches are solved once per
worker (a memo of bounded size)."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush
from math import inf
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from changeloom.llm.common import blobs, over_texts, texts

SPACE = "▁"
NO_PIECE = -1
_RUNS = re.compile(" +|[^ ]+")
PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Entries of a worker's memo before it starts anew; one older memo is kept.
MEMO = 400_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return out, at

    at = 0
    while at < len(raw):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = raw[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class PieceTransducer:
    """Compiled from the bytes of a model file (unigram or BPE; model_type reads
    it as another)."""

    UNIGRAM, BPE = 1, 2
    NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

    def __init__(self, model: bytes, model_type: int | None = None):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.model_type, self.dummy, self.squeeze, self.fallback = self.UNIGRAM, True, True, False
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kinds.append(part.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.model_type = trainer.get(3, self.UNIGRAM)
                self.fallback = bool(trainer.get(35, 0))
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2):
                    raise NotImplementedError("a model with a compiled character map")
                self.dummy, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.model_type = model_type or self.model_type
        if self.model_type not in (self.UNIGRAM, self.BPE):
            raise NotImplementedError(f"model type {self.model_type}")
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == self.BYTE}
        self.id_of = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] in (self.NORMAL, self.USER)}
        dummy = SPACE if self.dummy else ""
        #: The normaliser's states, all final: arcs of other characters and of blanks,
        #: each (output once, output for each character or None for itself, next state).
        if self.squeeze:
            self.normaliser = [((dummy, None, 1), ("", "", 0)), (("", None, 1), ("", "", 2)), ((SPACE, None, 1), ("", "", 2))]
        else:
            self.normaliser = [((dummy, None, 1), (dummy, SPACE, 1)), (("", None, 1), ("", SPACE, 1))]
        # A path's arcs cover the stretch, so the same cost added to each character
        # moves all paths alike; it keeps weights from falling below 0.
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == self.NORMAL]
        bpe, lift = self.model_type == self.BPE, max(0.0, *normal)
        self.no_piece = 0.0 if bpe else lift - (min(normal) - 10.0)
        self.trie: list = [NO_PIECE, 0.0, {}]  # a state: label of its final arc, weight, arcs by character
        for piece, i in self.id_of.items():
            node = self.trie
            for c in piece:
                node = node[2].setdefault(c, [NO_PIECE, 0.0, {}])
            node[:2] = i, 0.0 if bpe else lift * len(piece) - self.scores[i]
        self.longest = max(map(len, self.id_of))
        joined = {c for p in self.id_of if len(p) > 1 for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            self.cuts = None
        else:  # a cut is certain before blanks that follow something, and around these
            alone = "".join(c for c in "\n\t\r" if c not in joined)
            self.cuts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone or SPACE}]")
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict = {}
        self.width = len(self.pieces)

    def normalise(self, text: str) -> str:
        """Composition of a text with the normaliser, which is deterministic: one
        path. A run of one class takes its first arc once and then a loop."""
        out, state, arcs = [], 0, self.normaliser
        for run in _RUNS.findall(text):
            first, loop, state = arcs[state][run[0] == " "]
            if first:
                out.append(first)
            out.append(run if loop is None else loop * len(run))
        return "".join(out)

    def merged(self, stretch: str, stop: int = 1) -> list[str]:
        """The merges of a BPE model on a few characters: best score first,
        leftmost of equals."""
        parts, of, scores = list(stretch), self.id_of, self.scores
        while len(parts) > stop:
            best, at = -inf, -1
            for k in range(len(parts) - 1):
                i = of.get(parts[k] + parts[k + 1])
                if i is not None and scores[i] > best:
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, piece: int, right: bool) -> list[tuple[str, float]] | None:
        """What stands at one edge of a piece while its merges go on: (symbol,
        score of the merge that absorbs it), from the character to the piece.
        None where merges don't come in the order of their scores."""
        known = self.edges.get((piece, right), False)
        if known is False:
            at, out, over = self.pieces[piece], [], -inf
            while True:
                out.append((at, over))
                if len(at) == 1:
                    break
                halves = next(((at[:k], at[k:]) for k in range(1, len(at)) if self.merged_to(at, k)), None)
                score = self.scores[self.id_of[at]]
                if halves is None or score <= over or SPACE * 2 in at:
                    out = None
                    break
                at, over = halves[right], score
            known = self.edges[piece, right] = out and out[::-1]
        return known

    def merged_to(self, piece: str, k: int) -> bool:
        """Is the piece's last merge that of its first k characters and the rest?"""
        ids = self.id_of
        if (k > 1 and piece[:k] not in ids) or (len(piece) - k > 1 and piece[k:] not in ids):
            return False
        return self.merged(piece, stop=2) == [piece[:k], piece[k:]]

    def follows(self, a: int, b: int) -> bool:
        """The pair acceptor: is (a, b) the encoding of its concatenation? It is
        unless, at some time, the merge of the two symbols at the seam comes
        before those that absorb either of them."""
        key = a * self.width + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            left, right = self.edge(a, True), self.edge(b, False)
            if left is None or right is None:
                x, y = self.pieces[a], self.pieces[b]
                known = self.merged(x + y) == [x, y]
            else:
                i = j = 0
                known, of, scores = True, self.id_of, self.scores
                while True:
                    (u, after_u), (v, after_v) = left[i], right[j]
                    joint = of.get(u + v)
                    if joint is not None and scores[joint] > after_u and scores[joint] >= after_v:
                        known = False
                        break
                    if after_u == after_v == -inf:
                        break
                    if after_u >= after_v:
                        i += 1
                    else:
                        j += 1
            self.pairs[key] = known
        return known

    def rewrite(self, c: str) -> tuple[int, ...]:
        """What the fallback arc of a character without a piece puts out."""
        return tuple(self.byte[b] for b in c.encode()) if self.fallback else (self.unknown,)

    def shortest(self, stretch: str) -> list[int]:
        """Output of the tropical shortest path of the composition with one stretch.

        A state is (place, last label); a label from 0 is a piece, NO_PIECE rewrites
        one character. Without the pair acceptor the last label decides nothing, with
        it a prefix has one path of finite cost; so each place is settled once. The
        queue is shortest first, of equal costs the farthest place. Where all weights
        are 0 or infinity a stack has that order at less cost."""
        n, bpe, pairs, width, root, longest = len(stretch), self.model_type == self.BPE, self.pairs, self.width, self.trie[2], self.longest
        settled: list[tuple[int, int] | None] = [None] * (n + 1)
        queue = [(0.0, 0, 0, NO_PIECE)]  # (cost, -place, place before, label)
        push, pop = (queue.append, queue.pop) if bpe else (partial(heappush, queue), partial(heappop, queue))
        while True:
            cost, end, before, label = pop()
            at = -end
            if settled[at] is not None:
                continue
            if bpe and label >= 0:  # the pair acceptor's weight, asked for when the arc's turn comes
                last = settled[before][1]
                if last >= 0 and not (pairs.get(last * width + label) or self.follows(last, label)):
                    continue
            settled[at] = before, label
            if at == n:
                break
            node = root.get(stretch[at])
            if node is None or node[0] < 0:
                push((cost + self.no_piece, end - 1, at, NO_PIECE))
            arcs = root
            for c in stretch[at : at + longest]:
                node = arcs.get(c)
                if node is None:
                    break
                end -= 1
                label, weight, arcs = node
                if label >= 0:
                    push((cost + weight, end, at, label))
        labels = []
        while at:
            before, label = settled[at]
            labels.append((label,) if label >= 0 else self.rewrite(stretch[before:at]))
            at = before
        return [i for out in reversed(labels) for i in out]

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        if self.cuts is None:
            return self.shortest(text)
        memo, older, out = self.memo, self.older, []
        for stretch in self.cuts.findall(text):
            ids = memo.get(stretch)
            if ids is None:
                ids = older.get(stretch) or self.shortest(stretch)
                if len(stretch) <= 64:
                    if len(memo) >= MEMO:  # what was not met since the last turn is forgotten
                        self.older = older = memo
                        self.memo = memo = {}
                    memo[stretch] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The inverse transducer. Bytes that are no UTF-8 read as U+FFFD."""
        if not hasattr(self, "surface"):
            inverse = {i: bytes([b]) for b, i in self.byte.items()}
            self.surface = [
                inverse[i] if k == self.BYTE else b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else p.replace(SPACE, " ").encode()
                for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))
            ]
        raw = b"".join(map(self.surface.__getitem__, ids))
        return (raw[1:] if self.dummy and raw[:1] == b" " else raw).decode("utf-8", "replace")


_COMPILED: dict[bytes, PieceTransducer] = {}


def compiled(model: bytes) -> PieceTransducer:
    """One transducer for each model and Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _COMPILED:
        _COMPILED[key] = PieceTransducer(model)
    return _COMPILED[key]


def load(path: str = PATH) -> bytes:
    """The model file, read on the driver; a vocabulary is of bounded size (the
    file must stay under 64 MB), and travels with the tasks."""
    raw = Path(path).read_bytes()
    if len(raw) > 64 << 20:
        raise ValueError("a vocabulary over 64 MB")
    return raw


def encode_pieces(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_pieces, ids (array of int),
    round_trip (decoding gives the text again), decoded_sha256.

    Defined cases: a null or empty text has no pieces and decodes to ''; U+2581
    in a text decodes to a blank, so round_trip is false there; repeated rows
    give repeated rows; a very long text is one slice, searched stretch by
    stretch; an empty table gives an empty one. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model or load())  # bounded by load()

    def work(batch: pa.RecordBatch) -> dict:
        fst = compiled(shared.value)
        flat: list[int] = []
        ends, same, digests = [0], [], []
        for raw in blobs(batch):
            text = raw.decode("utf-8", "replace")
            ids = fst.encode(text)
            flat += ids
            ends.append(len(flat))
            back = fst.decode(ids)
            same.append(back == text)
            digests.append(hashlib.sha256(back.encode()).hexdigest())
        return {
            "doc_id": batch.column(0),
            "n_pieces": pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())),
            "round_trip": pa.array(same),
            "decoded_sha256": pa.array(digests),
        }

    return over_texts(texts(docs, id_col, text_col), work, "doc_id long, n_pieces long, ids array<int>, round_trip boolean, decoded_sha256 string", limit=1 << 20)


def decode_pieces(encoded: DataFrame, model: bytes | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with the column `text` added (or replaced), decoded from ids_col;
    null ids decode to null."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or load())
    keep = [f for f in encoded.schema.fields if f.name != "text"]
    from pyspark.sql import types as T

    schema = T.StructType([*keep, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(shared.value)
        for batch in batches:
            said = [None if ids is None else fst.decode(ids) for ids in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string())], [*(f.name for f in keep), "text"])

    return encoded.mapInArrow(run, schema)
