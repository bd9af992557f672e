"""SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The pieces of a model and their scores make an automaton. Encoding is one pass over the text:
at each position the automaton's output links name every piece that ends there, and each
relaxes the best score of its end from that of its start; the best path is read backwards. A
character that no piece covers costs the least score less `UNKNOWN`, and becomes the pieces
of its bytes, or the unknown piece where the model has none. Decoding is the inverse, but
that bytes which aren't UTF-8 become U+FFFD.

The model's own kind of search (merges, for a BPE model) is not run: paths are those of best
score, as in the lattice of a unigram model of the same pieces.

Where no piece has a space after another character, which is checked, the best path of a text
is that of its parts before each space after another character; parts met again are looked up.
New parts of many texts are encoded at once: the automaton of the pieces of two characters or
more, as a table of arrays, takes a character of every part a step. Long parts, and those with a
character that takes several bytes and has no piece, go through the automaton one by one; both
ways relax the same pieces in the same order and give the same paths.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from numpy.typing import NDArray
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: What a character without a piece costs beyond the least score; the library's value.
UNKNOWN = 10.0
PARTS = re.compile(" *[^ ]+| +")
MEMO = 300_000
#: Parts of so many characters are neither remembered nor encoded with others.
LONG = 64
#: Characters of texts, and parts, that are encoded at once; cells that a table may have (a larger model does without).
GROUP, LANES, CELLS = 1 << 21, 8192, 1 << 26


class Table:
    """The automaton of pieces of two characters or more, in arrays, for many texts at once; node 0 is the root.

    pieces: ids and scores by text. alone: those of single characters that have no piece. A
    character that has neither is of class 0, and a text that has one is left out. fits:
    whether the model isn't too large.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], alone: dict[str, tuple[int, float]], n_ids: int) -> None:
        known = alone | {p: x for p, x in pieces.items() if len(p) == 1}
        longer = {p: x for p, x in pieces.items() if len(p) > 1 and known.keys() >= set(p)}
        letters = dict.fromkeys(chain.from_iterable(longer))
        order = [*letters, *(c for c in known if c not in letters)]  # the classes from 1; letters of longer pieces are columns too
        self.fits = len(order) < 1 << 16
        if not self.fits:
            return
        self.columns = len(letters) + 1
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in order]] = np.arange(1, len(order) + 1)
        self.alone = np.array([0, *(known[c][0] for c in order)], np.int32)
        self.alone_score = np.array([0.0, *(known[c][1] for c in order)])
        self.size = np.ones(n_ids, np.int64)
        below: list[dict[int, int]] = [{}]
        ends: dict[int, tuple[int, float]] = {}
        column = {c: k for k, c in enumerate(letters, 1)}
        for p, (k, score) in longer.items():
            self.size[k] = len(p)
            at = 0
            for c in p:
                if (to := below[at].get(column[c])) is None:
                    to = below[at][column[c]] = len(below)
                    below.append({})
                at = to
            ends[at] = k, score
        n = len(below)
        self.fits = n * self.columns <= CELLS
        if not self.fits:
            return
        self.piece, self.score = np.full(n, -1, np.int32), np.zeros(n)
        for at, (k, score) in ends.items():
            self.piece[at], self.score[at] = k, score
        self.go = np.zeros((n, self.columns), np.uint16 if n < 1 << 16 else np.int32)
        fall, self.link, self.first = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, np.int32)
        level = [0]
        while level:  # nodes by depth: where a node falls to is known before it
            for at in level:
                if at:
                    self.go[at] = self.go[fall[at]]
                    self.link[at] = self.first[fall[at]]
                    self.first[at] = at if self.piece[at] >= 0 else self.link[at]
                for c, to in below[at].items():
                    fall[to] = self.go[at, c]  # at the root, still the root
                    self.go[at, c] = to
            level = [to for at in level for to in below[at].values()]
        self.go = self.go.reshape(-1)

    def paths(self, texts: list[str]) -> Iterator[tuple[str, bytes, float]]:
        """Each text that has no character of class 0, the ids of its best path and their score; texts aren't empty, spaces are U+2581."""
        texts = sorted(texts, key=len, reverse=True)
        for at in range(0, len(texts), LANES):
            some = texts[at : at + LANES]
            found = self.classes[np.frombuffer("".join(some).encode("utf-32-le", "surrogatepass"), "<u4")]
            sizes = np.fromiter(map(len, some), np.int64, len(some))
            whole = np.minimum.reduceat(found, np.cumsum(sizes) - sizes) > 0
            if not whole.all():
                some = [x for x, w in zip(some, whole.tolist(), strict=True) if w]
                found, sizes = found[np.repeat(whole, sizes)], sizes[whole]
            if some:
                yield from zip(some, *self._paths(found, sizes), strict=True)

    def _paths(self, found: NDArray, sizes: NDArray) -> tuple[list[bytes], list[float]]:
        n, most = len(sizes), int(sizes[0])
        lane = np.arange(n)
        letters = np.zeros((most, n), np.uint16)
        letters[np.arange(len(found)) - np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(lane, sizes)] = found
        best, piece = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int32)
        node = np.zeros(n, np.int64)
        active = n - np.searchsorted(sizes[::-1], np.arange(most), side="right")  # texts longer than a place come first
        for p, m in enumerate(active.tolist()):
            c = letters[p, :m]
            node = self.go[node[:m] * self.columns + np.where(c < self.columns, c, 0)].astype(np.int64)
            top, of = np.full(m, -np.inf), piece[p + 1, :m]
            rows = np.flatnonzero(self.first[node])
            at = self.first[node[rows]]
            while len(rows):  # pieces that end here, the longest first
                k = self.piece[at]
                s = best[p + 1 - self.size[k], rows] + self.score[at]
                more = s > top[rows]
                top[rows[more]], of[rows[more]] = s[more], k[more]
                at = self.link[at]
                on = np.flatnonzero(at)
                rows, at = rows[on], at[on]
            s = best[p, :m] + self.alone_score[c]
            more = s > top
            best[p + 1, :m] = np.where(more, s, top)
            of[more] = self.alone[c[more]]
        steps: list[tuple[NDArray, NDArray]] = []
        rows, at, count = lane, sizes, np.zeros(n, np.int64)
        while len(rows):  # backwards
            k = piece[at, rows]
            steps.append((rows, k))
            count[rows] += 1
            at = at - self.size[k]
            on = np.flatnonzero(at)
            rows, at = rows[on], at[on]
        end = np.cumsum(count)
        ids = np.zeros(int(end[-1]), "<u4")
        for back, (rows, k) in enumerate(steps, 1):
            ids[end[rows] - back] = k
        data = ids.tobytes()
        bounds = [0, *(end * 4).tolist()]
        return [data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], best[sizes, lane].tolist()


class Codec:
    """Encodes and decodes by a SentencePiece model file whose normaliser keeps texts as they are."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(k) for k in range(n)]
        self.byte = {int(p[3:-1], 16): k for k, p in enumerate(self.pieces) if model.is_byte(k)}
        self.control = {k for k in range(n) if model.is_control(k)}
        self.unknown = model.unk_id()
        usual = [k for k in range(n) if k not in self.control and k != self.unknown and not model.is_byte(k) and not model.is_unused(k)]
        self.scores = {k: model.get_score(k) for k in usual}
        self.lowest = min(self.scores.values(), default=0.0) - UNKNOWN
        self.automaton = ahocorasick.Automaton()
        for k in usual:
            self.automaton.add_word(self.pieces[k], (k, len(self.pieces[k]), self.scores[k]))
        self.automaton.make_automaton()
        self.parts = all(SPACE not in self.pieces[k].lstrip(SPACE) for k in usual)
        text_of = {k: self.pieces[k].replace(SPACE, " ").encode() for k in usual} | {k: bytes([b]) for b, k in self.byte.items()} | {k: b"" for k in self.control} | {self.unknown: " ⁇ ".encode()}
        self.text_of = [text_of.get(k) for k in range(n)]
        #: By part, without its space if it has one and other characters.
        self.memo: dict[str, tuple[bytes, float]] = {}
        byte_alone = {chr(b): (k, self.lowest) for b, k in self.byte.items() if b < 0x80}
        self.table = Table({self.pieces[k]: (k, s) for k, s in self.scores.items()}, byte_alone, n)

    def path(self, text: str) -> tuple[list[int], float]:
        """The best path over text (spaces written as U+2581), and its score; equal scores go to the piece that starts first."""
        n = len(text)
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        done, lowest = 0, self.lowest  # ends up to `done` are settled
        single = [False] * (n + 1)
        for last, (k, size, score) in self.automaton.iter(text):
            end = last + 1
            if end - 1 > done:
                self._settle(best, start, piece, single, done, end - 1, lowest)
                done = end - 1
            s = best[end - size] + score
            if size == 1:
                single[end] = True
            if s > best[end]:
                best[end], start[end], piece[end] = s, end - size, k
        self._settle(best, start, piece, single, done, n, lowest)
        ids: list[int] = []
        at = n
        while at:
            if piece[at] >= 0:
                ids.append(piece[at])
            elif self.byte:
                ids += [self.byte[b] for b in reversed(text[at - 1].encode())]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at = start[at]
        return ids[::-1], best[n]

    @staticmethod
    def _settle(best: list, start: list, piece: list, single: list, done: int, upto: int, lowest: float) -> None:
        """Lets a character without a piece of its own be unknown, for ends after `done` up to `upto`."""
        for e in range(done + 1, upto + 1):
            if not single[e] and (s := best[e - 1] + lowest) > best[e]:
                best[e], start[e], piece[e] = s, e - 1, -1

    def whole(self, text: str) -> tuple[bytes, float]:
        ids, score = self.path(text)
        return struct.pack(f"<{len(ids)}I", *ids), score

    @staticmethod
    def keys(text: str) -> list[str]:
        """The parts of a text, as they are remembered."""
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [p if p[1:2] in ("", " ") else p[1:] for p in PARTS.findall(" " + text)]

    def learn(self, keys: Iterable[str]) -> None:
        """Remembers the parts of new keys."""
        new = {(k if k[0] == " " else " " + k).replace(" ", SPACE): k for k in keys}
        if self.table.fits:
            for part, ids, score in self.table.paths([p for p in new if len(p) < LONG]):
                self.memo[new.pop(part)] = ids, score
        for part, k in new.items():
            self.memo[k] = self.whole(part)

    def encode_texts(self, texts: list[str]) -> list[tuple[bytes, float]]:
        """encode() of each text; new parts of all of them are encoded together."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        keys = [self.keys(x) if x and self.parts and SPACE not in x else [] for x in texts]
        new = set(chain.from_iterable(keys)).difference(self.memo)
        self.learn(new)
        coded: list[tuple[bytes, float]] = []
        for text, own in zip(texts, keys, strict=True):
            if own:
                found = list(map(self.memo.__getitem__, own))
                coded.append((b"".join([f[0] for f in found]), sum([f[1] for f in found])))
            else:
                coded.append(self.whole((" " + text).replace(" ", SPACE)) if text else (b"", 0.0))
        for k in new:
            if len(k) >= LONG - 1:
                del self.memo[k]
        return coded

    def encode(self, text: str) -> tuple[bytes, float]:
        """Little-endian unsigned 32-bit ids of a whole text, and the score of their path; the empty text has none."""
        return self.encode_texts([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a process and file."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, model: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """df without its texts; n_pieces, ids_crc32, score (of the path), round_trip (whether decoding gives the text back) and, with keep_ids, ids (binary: little-endian unsigned 32-bit).

    A null text is encoded as an empty one: no ids, and it comes back. A text that has U+2581
    itself doesn't come back. Columns of df that have the names of new ones are replaced.
    """
    new = ["n_pieces", "ids_crc32", "score", "round_trip", *["ids"] * keep_ids]
    keep = [f for f in df.schema.fields if f.name != text and f.name not in new]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_pieces long, ids_crc32 long, score double, round_trip boolean"] + ["ids binary"] * keep_ids)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            column, at = batch.column(len(keep)), 0
            while at < batch.num_rows:
                texts: list[str] = []
                size = 0
                while at + len(texts) < batch.num_rows and len(texts) < 1000 and size < GROUP:
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                some = batch.slice(at, len(texts))
                at += len(texts)
                rows: list[tuple] = []
                for x, (ids, score) in zip(texts, own.encode_texts(texts), strict=True):
                    rows.append((len(ids) // 4, zlib.crc32(ids), score, own.decode(np.frombuffer(ids, "<u4").tolist()) == x, ids))
                values = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *values[: len(new)]], names=[*(f.name for f in keep), *new])

    return df.select(*(F.col(f"`{f.name}`") for f in keep), F.col(f"`{text}`")).mapInArrow(encoded, schema)


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the texts of its ids (binary, as encode() gives them); null ids give a null text."""
    keep = [f for f in df.schema.fields if f.name != text]
    at = [f.name for f in keep].index(ids)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"`{text}` string"])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            texts = [None if (x := v.as_py()) is None else own.decode(np.frombuffer(x, "<u4").tolist()) for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.select(*(F.col(f"`{f.name}`") for f in keep)).mapInArrow(decoded, schema)
