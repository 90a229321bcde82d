"""Operator 4: SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a model file:

- the normaliser: a blank is read and U+2581 written, any other character is written as read;
  its first arc reads nothing and writes the dummy prefix;
- the pieces: a trie that reads a piece's characters and writes its id, and the byte machine,
  which reads a character that is no piece and writes one label that stands for the ids of its bytes;
- the acceptor of neighbouring pieces, for byte-pair models: weight zero for two pieces that
  byte-pair merging leaves apart, infinite for others.  Unigram models have none; there the negative scores are
  weights of the pieces' arcs.

Normaliser, pieces and byte machine are composed once (`compose`).  The composed machine is then composed
with each input: its arcs over the input's positions are a lattice, and the result is the
shortest path through it in the tropical semiring (min, +), with the acceptor's weights added between
neighbouring arcs.  A segmentation all of whose neighbouring pairs are accepted is the merged one,
so a byte-pair lattice has one path of finite weight to each position, and its states
need no more memory than the piece before.

Whether a pair is accepted is read from the two pieces' own merge trees (`Merges`), not by merging the input.

No piece holds U+2581 after another character (checked at compilation; else texts are taken
whole), so the path through a text is the concatenation of the paths through its blank-led
units, and paths of short units are kept in a bounded cache.

Decoding reads the path's output side: pieces to characters, byte pieces to bytes (invalid
sequences to U+FFFD), U+2581 to blanks, without the dummy prefix.

Defined cases: null and empty texts encode to no ids and decode to the empty string; a text
that holds U+2581 itself decodes with blanks there, as in the library; a null id is carried through; repeated rows are
encoded one by one; of paths of equal weight the one whose piece reached its end first stays (for
byte-pair models the acceptor leaves one path only); very long texts and units are whole; other columns are
ignored; an empty table gives an empty one.  Models with a character map, white-space removal or user-defined pieces are
refused.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CACHE, CACHED_UNIT = 250_000, 48  # paths in each of two generations, characters of a unit
INF = float("inf")


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message: integers, raw bytes or four-byte floats."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = b[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(b):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or number()
            i += n
            yield key >> 3, b[i - n : i]


class Merges:
    """Merge trees of the pieces of a byte-pair model, and the acceptor of neighbouring pieces."""

    def __init__(self, arcs: dict[str, int], scores: list[float]):
        self.arcs, self.scores = arcs, scores
        self.halves: dict[str, tuple[str, str] | None] = {}
        self.times: dict[str, float] = {}
        self.rims: dict[tuple[str, int], list[tuple[str, float]]] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge of a piece joins; None for one character and for what merging never yields."""
        if piece not in self.halves:
            parts, last = list(piece), None
            while len(parts) > 1:
                found = [(-self.scores[j], i) for i in range(len(parts) - 1) if (j := self.arcs.get(parts[i] + parts[i + 1])) is not None]
                if not found:
                    break
                i = min(found)[1]
                last = parts[i], parts[i + 1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[piece] = last if len(parts) == 1 else None
        return self.halves[piece]

    def time(self, piece: str) -> float:
        """When merging has made a piece: the greatest negative score in its tree."""
        if piece not in self.times:
            halves = self.split(piece)
            self.times[piece] = max(-self.scores[self.arcs[piece]], *map(self.time, halves)) if halves else -INF
        return self.times[piece]

    def rim(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at one side of a piece (0 left, 1 right) while it is being made, and when each is used up; innermost first."""
        key = piece, side
        if key not in self.rims:
            out, until = [(piece, INF)], self.split(piece)
            while until:
                whole = out[-1][0]
                out.append((until[side], self.time(whole)))
                until = self.split(until[side])
            self.rims[key] = out[::-1]
        return self.rims[key]

    def apart(self, left: str, right: str) -> bool:
        """Does merging leave the border between two pieces? A merge across it must never come before both of its parts are used up.

        Of merges with equal scores the leftmost comes first.
        """
        if any(len(p) > 1 and self.split(p) is None for p in (left, right)):
            return False
        a, b = self.rim(left, 1), self.rim(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            k = self.arcs.get(x + y)
            if k is not None and -self.scores[k] < x_until and -self.scores[k] <= y_until:
                return False
            if x_until == y_until == INF:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1


def compose(normaliser: dict[str, str], trie: dict, other: int = -1) -> tuple[dict, int]:
    """The machine that reads what the normaliser reads and writes what the pieces and the byte machine write.

    normaliser: characters that it rewrites (all others pass as they are).  trie: nested maps from
    a character to the next state, None to the id that is written there.  A state of the
    result is a pair: a map from a character to the next state, and the label that is written there, -1 for none.
    The byte machine is a part of it: a character that begins pieces but is none leads to a state that writes `other`, the
    label of its bytes, and what has no arc at the start goes along one default arc that writes `other`, too (-1: there are no
    such arcs).  Returned are the arcs of the start and the label of the default arc.
    """
    read: dict[str, list[str]] = {}
    for c, written in normaliser.items():
        read.setdefault(written, []).append(c)
    start: dict = {}
    todo = [(trie, start, other)]
    while todo:
        state, arcs, unwritten = todo.pop()
        for c, following in state.items():
            if c is not None:
                target: tuple[dict, int] = ({}, following.get(None, unwritten))
                for x in (*([] if c in normaliser else [c]), *read.get(c, ())):
                    arcs[x] = target
                todo.append((following, target[0], -1))
    return start, other


class Transducer:
    def __init__(self, model: bytes):
        self.pieces, self.kinds, self.kind = [], [], UNIGRAM
        self.scores: list[float] = []
        self.prefix, squeeze = True, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                f = dict(_fields(value))
                if f.get(2):
                    raise ValueError("character maps are not supported")
                self.prefix, squeeze = bool(f.get(3, 1)), bool(f.get(4, 1))
        if squeeze or USER in self.kinds or self.kind not in (UNIGRAM, BPE):
            raise ValueError("this kind of model is not supported")
        self.arcs = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        trie: dict = {}
        for p, k in self.arcs.items():
            state = trie
            for c in p:
                state = state.setdefault(c, {})
            state[None] = k
        self.other = len(self.pieces)  # the label of the byte machine's arcs
        self.machine = compose({" ": BLANK}, trie, self.other)
        crosses = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.arcs)
        self.units = re.compile("(?s).+" if crosses else f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")
        worst = min((s for s, k in zip(self.scores, self.kinds) if k == NORMAL), default=0.0) - 10
        self.weight = [0.0 if self.kind == BPE else -s for s in (*self.scores, worst)]  # the last is that of a character that is no piece
        self.merges = Merges(self.arcs, self.scores) if self.kind == BPE else None
        self.accepted: dict[int, dict[int, bool]] = {}
        self.pairs = 0
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(BLANK, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    def accepts(self, left: int, right: int) -> bool:
        """Has the acceptor an arc of weight zero for these two pieces?"""
        row = self.accepted.get(left)
        if row is None:
            if self.pairs >= 4 * CACHE:
                self.accepted.clear()
                self.pairs = 0
            row = self.accepted[left] = {}
        known = row.get(right)
        if known is None:
            known = row[right] = self.other in (left, right) or self.merges.apart(self.pieces[left], self.pieces[right])
            self.pairs += 1
        return known

    def path(self, unit: str) -> tuple[int, ...]:
        """Output labels of the shortest path through the lattice of a unit, which is the machine composed with the input.

        The lattice is made from left to right, only where a path of finite weight arrives.
        """
        n, start, weight, accepted, bpe = len(unit), self.machine[0], self.weight, self.accepted, self.merges is not None
        otherwise = {}, self.machine[1]
        cost: list[float] = [0.0] + [INF] * n
        into: list[tuple[int, int]] = [(0, -1)] * (n + 1)  # the arc on the best path to each position: where it begins, its label
        for at in range(n):
            here = cost[at]
            if here == INF:
                continue
            last = into[at][1] if bpe else -1
            near = accepted.get(last) or {}
            state, end = start.get(unit[at], otherwise), at
            while state is not None:
                arcs, label = state
                end += 1
                if label >= 0:
                    w = here + weight[label]
                    if w < cost[end]:
                        ok = last < 0 or near.get(label)
                        if ok or (ok is None and self.accepts(last, label)):
                            cost[end], into[end] = w, (at, label)
                state = arcs.get(unit[end]) if arcs and end < n else None
        out: list[list[int]] = []
        while n:
            at, label = into[n]
            if label != self.other:
                out.append([label])
            elif self.bytes:
                out.append([self.bytes[b] for b in unit[at:n].replace(" ", BLANK).encode("utf-8", "surrogatepass")])
            else:
                out.append([self.unknown])
            n = at
        return tuple(k for part in reversed(out) for k in part)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.cache.get
        if self.prefix and text:
            text = " " + text  # the normaliser's first arc
        for unit in self.units.findall(text):
            ids = known(unit)
            if ids is None:
                ids = self.older.get(unit)
                if ids is None:
                    ids = self.path(unit)
                if len(unit) <= CACHED_UNIT:
                    if len(self.cache) >= CACHE:
                        self.older, self.cache = self.cache, {}
                        known = self.cache.get
                    self.cache[unit] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def default_model() -> str:
    """Place of the public byte-fallback model; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces_of(docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids, decoded_sha256, lossless for each row of `docs` (doc_id, text)."""
    with open(model_file or default_model(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        t = transducer(sent.value)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id.astype("Int64"), pdf.text):
                text = text if isinstance(text, str) else ""
                ids = t.encode(text)
                back = t.decode(ids)
                rows.append((doc, len(ids), ids, hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
                if len(rows) == 500:
                    yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids", "decoded_sha256", "lossless"]).astype({"doc_id": "Int64"})
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "n_ids", "ids", "decoded_sha256", "lossless"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string, lossless boolean"
    )
