"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is the composition of three, each compiled once: the normaliser (two states: before the text, where an arc
without input writes the leading meta symbol, and within it, where spaces become meta symbols), the pieces (a deterministic
automaton over characters, with a final state for each piece), and byte fallback (an arc for each character that no piece
covers, writing its bytes).  Composed with an input, lazily, a state of it is (place in the input, last piece), and its arcs
are the pieces that the automaton accepts from that place.  Weights are in the tropical semiring (min, +).  With the merges of
a ranked vocabulary an arc weighs nothing, or infinity where the two pieces could not stand side by side after the merges;
exactly one path of finite weight is left, the model's own segmentation.  With unigram scores the weights are the negated
scores, and no neighbours are forbidden.

Shortest path: distances are relaxed from the initial state, infinite to finite or to less, and states wait in a queue.  For
weights of nothing and infinity the queue is last in, first out, with the longest piece last, so it rarely looks at more than
the path; for scores it is the order of places.  Both are linear in the input.  Decoding reads the transducer from its other
side.

No piece reaches across the start of a word (a space after something else), so shortest paths are composed of the paths of
words, which each worker remembers.

Defined cases: null text gives null ids, count and text; empty text gives no ids.  Control pieces in a text are plain text.
Ids outside the vocabulary can't be decoded and raise.  Text that holds the meta symbol itself, or unpaired surrogates,
decodes to spaces or replacement characters, and the lossless flag says so.  Rows are independent: repeats, missing ids
and other columns change nothing.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """Pieces, scores and kinds of a SentencePiece model file, and its normaliser's settings."""

    def __init__(self, path: str = MODEL):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.unigram, self.byte_fallback, self.prefix, extra, self.escape, charsmap = True, False, True, True, True, b""
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                spec = dict(_fields(value))
                self.unigram, self.byte_fallback = spec.get(3, 1) == 1, bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                charsmap, self.prefix, extra, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if charsmap or extra or not self.escape or not self.byte_fallback:
            raise ValueError("only models with the identity normaliser, escaped spaces and byte fallback are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.longest = max(map(len, self.ids))
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece reaches across the start of a word")
        self.outputs = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.encode() for p, k in zip(self.pieces, self.kinds)]


class Pieces:
    """The automaton of the pieces: a state for every start of a piece, an arc for every character that goes on."""

    def __init__(self, pieces):
        self.arcs: list[dict[str, int]] = [{}]
        self.piece: list[str] = [""]
        for p in pieces:
            state = 0
            for c in p:
                after = self.arcs[state].get(c)
                if after is None:
                    after = self.arcs[state][c] = len(self.arcs)
                    self.arcs.append({})
                    self.piece.append("")
                state = after
            self.piece[state] = p

    def accepted(self, text: str, at: int) -> list[str]:
        """The pieces that stand in the text at a place, shortest first; if no single character does, the arc of byte fallback."""
        arcs, piece, out, state = self.arcs, self.piece, [], 0
        for i in range(at, len(text)):
            state = arcs[state].get(text[i])
            if state is None:
                break
            if piece[state]:
                out.append(piece[state])
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        return out


class Transducer:
    """Encoder and decoder over a vocabulary."""

    def __init__(self, path: str = MODEL):
        self.v = Vocabulary(path)
        self.starts = re.compile(f"{SPACE}*[^{SPACE}]*")
        self.normaliser = str.maketrans({" ": SPACE})
        # rank of the merge that makes a piece; pieces that the merges can't make are in no path
        self.rank = {p: -self.v.scores[i] for p, i in self.v.ids.items() if len(p) > 1}
        self.halves = {} if self.v.unigram else {p: h for p in self.rank if (h := self._last_merge(p))}
        self.beside = Memo(lambda pair: self._stands(*pair), 200_000)
        self.pieces = Pieces(p for p in self.v.ids if self.v.unigram or len(p) == 1 or p in self.halves)
        self.unknown = min((s for s, k in zip(self.v.scores, self.v.kinds) if k == NORMAL), default=0.0) - 10
        self.inner_breaks = not any("\n" in p for p in self.v.ids)
        # a word's ids, packed, with and without the space before it; a run's ids
        self.words, self.bare, self.runs = Memo(self._word, 400_000), Memo(self._packed, 50_000), Memo(self._run, 1000)

    def _packed(self, text: str) -> bytes:
        return array("i", self.chunk(text)).tobytes()

    def _word(self, text: str) -> bytes:
        """Packed ids of a word after one space."""
        if self.v.unigram:
            return self._packed(SPACE + text)
        symbols, ids = self._ranked(SPACE + text), self.v.ids
        try:
            return array("i", [ids[s] for s in symbols]).tobytes()
        except KeyError:
            return array("i", [i for s in symbols for i in self._ids(s)]).tobytes()

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes the piece, if the ranked merges make it."""
        s, rank = list(piece), self.rank
        while len(s) > 2:
            r, at = min(((rank.get(s[i] + s[i + 1], float("inf")), i) for i in range(len(s) - 1)))
            if r == float("inf"):
                return None
            s[at : at + 2] = [s[at] + s[at + 1]]
        return (s[0], s[1]) if len(s) == 2 else None

    def _stands(self, a: str, b: str) -> bool:
        """Whether b can follow a: undoing their merges, latest first, no merge across the border would have come sooner."""
        rank, halves, limit = self.rank, self.halves, float("inf")
        ra, rb = rank.get(a, -1.0), rank.get(b, -1.0)
        while True:
            if rank.get(a + b, limit) < limit:
                return False
            if ra > rb:
                limit, a = ra, halves[a][1]
                ra = rank.get(a, -1.0)
            elif rb >= 0:
                limit, b = rb + 0.5, halves[b][0]  # of equal ranks, the one further left comes first
                rb = rank.get(b, -1.0)
            else:
                return True

    def _ids(self, symbol: str) -> list[int]:
        i = self.v.ids.get(symbol)
        return [i] if i is not None else [self.v.byte_ids[b] for b in symbol.encode("utf-8", "replace")]

    def _ranked(self, text: str) -> list[str]:
        """Shortest path with the weights of ranked merges: zero, or infinity for neighbours that the merges forbid."""
        accepted, beside, n = self.pieces.accepted, self.beside, len(text)
        # a state waits as (place, piece that led to it, the state before); the distance of one that was reached is zero
        waiting: list[tuple] = [(0, "", None)]
        reached: set[tuple[int, str]] = set()
        while waiting:
            state = waiting.pop()
            at, last, back = state
            if back is not None and back[1] and not beside[back[1], last]:
                continue
            if at == n:
                break
            if back is not None and len(waiting) > 1:
                if (at, last) in reached:
                    continue
                reached.add((at, last))
            for p in accepted(text, at):
                waiting.append((at + len(p), p, state))
        else:
            raise ValueError(f"no path for {text!r}")
        out = []
        while state[2] is not None:
            out.append(state[1])
            state = state[2]
        return out[::-1]

    def _scored(self, text: str) -> list[str]:
        """Shortest path with the negated unigram scores as weights; of equal paths, the one whose last piece starts first."""
        ids, scores, n = self.v.ids, self.v.scores, len(text)
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for j in range(n):
            for p in self.pieces.accepted(text, j):
                i = j + len(p)
                c = cost[j] - (scores[ids[p]] if p in ids else self.unknown)
                if c < cost[i]:
                    cost[i], back[i] = c, j
        out = []
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1]

    def _run(self, m: int) -> list[int]:
        return [i for s in self._ranked(SPACE * m) for i in self._ids(s)]

    def chunk(self, text: str) -> list[int]:
        """Ids of a run of meta symbols and the word that follows it."""
        if self.v.unigram:
            return [i for s in self._scored(text) for i in self._ids(s)]
        word = text.lstrip(SPACE)
        m = len(text) - len(word)
        symbols, out = self._ranked(SPACE * (m > 0) + word), []
        if m > 1:
            # spaces before the last merge among themselves, and with the last if the word left it alone
            alone = symbols[:1] == [SPACE]
            out += self.runs[m if alone else m - 1]
            symbols = symbols[alone:]
        try:
            return out + [self.v.ids[s] for s in symbols]
        except KeyError:
            return out + [i for s in symbols for i in self._ids(s)]

    def _line(self, text: str, space: bool) -> list[bytes]:
        parts = text.split(" ")
        if "" in parts or SPACE in text:
            return [self._packed(x) for x in self.starts.findall(SPACE * space + text.translate(self.normaliser)) if x]
        out = list(map(self.words.__getitem__, parts))
        if not space:
            out[0] = self.bare[parts[0]]
        return out

    def encoded(self, text: str) -> bytes:
        """The ids as packed 32-bit integers."""
        if not text:
            return b""
        if "\n" not in text or not self.inner_breaks:
            return b"".join(self._line(text, self.v.prefix))
        lines, feed, out = text.split("\n"), self.bare["\n"], []
        for k, line in enumerate(lines):
            if k:
                out.append(feed)
            if line or (k == 0 and self.v.prefix):
                out += self._line(line, self.v.prefix and k == 0)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.v.outputs.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.v.prefix and text[:1] == " " else text


@functools.lru_cache(1)
def transducer(path: str) -> Transducer:
    """One for a worker process, with what it remembers of words."""
    return Transducer(path)


def encode_decode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows (doc_id, ids, n_tokens, decoded, lossless): each text's ids, and the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model)
        for part in slices(batches, 256):
            packed = [None if x is None else t.encoded(x) for x in part["text"]]
            count = [None if x is None else len(x) // 4 for x in packed]
            back = [None if x is None else t.decode(np.frombuffer(x, np.int32).tolist()) for x in packed]
            flat = pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32))
            ends = np.cumsum([0] + [n or 0 for n in count])
            ids = pa.ListArray.from_arrays(pa.array([None if n is None else int(e) for n, e in zip(count, ends)] + [int(ends[-1])], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["doc_id"], pa.int64()), ids, pa.array(count, pa.int32()), pa.array(back, pa.string()), pa.array([None if x is None else x == y for x, y in zip(part["text"], back)], pa.bool_())],
                ["doc_id", "ids", "n_tokens", "decoded", "lossless"],
            )

    return lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, decoded string, lossless boolean")


def default_model(spark) -> str:
    """The model file: spark.marlwick.tokenizer if set, else MODEL."""
    path = spark.conf.get("spark.marlwick.tokenizer", MODEL)
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path
