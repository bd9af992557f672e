"""Token ids of whole texts by a file of the tokenizers library, remembered by chunk.

Texts are parted where the tokenizer's own rules never join across, so that the ids of a text
are those of its chunks in turn. Chunks met again are looked up. A new chunk that is a plain
word (Latin letters, then perhaps marks) goes to the library's model word by word, as the
tokenizer's own rules would part it; any other goes through the whole tokenizer. Which parting
is right is read from the tokenizer's description; for one that is not known here, whole texts
are encoded.

Where white space begins the next chunk, many texts are parted together, in arrays over their
bytes, down to plain words: only words that differ are looked up, and only new ones are handled
one by one.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: What is remembered goes once it has so many chunks or bytes; results don't depend on it.
MEMO_CHUNKS, MEMO_BYTES = 700_000, 96 << 20
#: White space to the tokenizers' patterns that bytes.split() and \s in bytes don't know, and, first, what only the latter take for it.
SEPARATORS = "\x1c\x1d\x1e\x1f"
OTHER_SPACE = SEPARATORS + "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Letters that normalisation keeps as they are, and ASCII signs other than the apostrophe.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of texts that are parted together, at most; a longer text is cut after so many, before a space that ends a word.
TOGETHER = 8 << 20
CUT = re.compile(rb"(?<=\S) ")
PACKS = [struct.Struct(f"<{n}I").pack for n in range(64)]


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the others, in order, from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}


BYTE_LETTERS = byte_letters()


def parting(description: dict) -> str:
    """'words': white space parts and is dropped; 'spaced': it begins the next chunk; '': unknown."""
    before = description.get("pre_tokenizer") or {}
    norm = description.get("normalizer")
    if description.get("model", {}).get("type") != "BPE" or any(not x.get("special") for x in description.get("added_tokens", [])):
        return ""
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and norm is None:
        return "spaced"
    steps = before.get("pretokenizers", [])
    if before.get("type") == "Sequence" and [s["type"] for s in steps] == ["Split", "ByteLevel"] and not steps[1]["use_regex"]:
        kinds = {x["type"] for x in (norm or {}).get("normalizers", [])}
        pattern = steps[0]["pattern"].get("Regex", "")
        if steps[0]["invert"] and steps[0]["behavior"] == "Removed" and kinds <= {"NFC", "Replace", "Lowercase"} and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return "words"
    return ""


#: What bytes are to the byte-level pattern; within a chunk, LETTER, DIGIT and SIGN each make a word. Of what isn't ASCII, only U+00C0 to U+00FF but for the two signs there (C3 97, C3 B7) count as letters, which no other character's first byte does.
SPACE, LINE, BLANK, LETTER, DIGIT, SIGN, OTHER = range(7)
KINDS = np.full(256, OTHER, np.uint8)
for _kind, _bytes in ((SPACE, b" "), (LINE, b"\n"), (BLANK, b"\t\r\x0b\x0c"), (DIGIT, b"0123456789"), (SIGN, b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"), (LETTER, bytes([*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]))):
    KINDS[list(_bytes)] = _kind
KINDS[[0x97, 0xB7]] = OTHER
WORD = re.compile(rb" ?(?:[A-Za-z\xc3\x80-\x96\x98-\xb6\xb8-\xbf]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Each byte's letter, but for line breaks, which part words.
LETTERS = np.array([10 if b == 10 else ord(BYTE_LETTERS[b]) for b in range(256)], "<u4")
#: OTHER_SPACE in UTF-8, as numbers, by length; and the bytes that these begin with.
SPACE_CODES = {n: np.array([int.from_bytes(c.encode()) for c in OTHER_SPACE if len(c.encode()) == n]) for n in (1, 2, 3)}
SPACE_BEGINS = np.zeros(256, bool)
SPACE_BEGINS[[c.encode()[0] for c in OTHER_SPACE]] = True


def holders(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which texts (data, cut at ends) hold a character of OTHER_SPACE."""
    at = np.flatnonzero(SPACE_BEGINS[data])
    codes, found = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for n, known in SPACE_CODES.items():
        codes = codes << 8 | np.where(at + n <= len(data), data[np.minimum(at + n - 1, len(data) - 1)], 0)
        found |= np.isin(codes, known)
    return np.unique(np.searchsorted(ends, at[found], "right"))


def tiles(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the parts of texts begin that a byte-level pattern never joins, and the end of all; data are bytes, texts lie between bounds.

    White space begins a chunk, and a single line break between words is one. A chunk of letters,
    digits and signs after one space at most is parted where these change; any other chunk, and a
    text with a character of OTHER_SPACE, is left whole.
    """
    n = len(data)
    kind = KINDS[data]
    blank = kind < LETTER
    begins = np.zeros(n + 1, bool)
    np.logical_and(blank[1:], ~blank[:-1], out=begins[1:n])
    text = np.zeros(n + 1, bool)
    text[bounds] = True
    begins |= text
    lines = np.flatnonzero(kind == LINE)
    alone = (text[lines] | ~blank[lines - 1]) & (text[lines + 1] | ~blank[np.minimum(lines + 1, n - 1)])
    begins[lines[alone] + 1] = True
    chunks = np.flatnonzero(begins[:n])
    mixed = np.zeros(len(chunks), bool)
    mixed[np.searchsorted(chunks, np.flatnonzero((kind == OTHER) | (kind == BLANK) | (blank & ~begins[:n])), "right") - 1] = True
    changes = np.flatnonzero((kind[1:] != kind[:-1]) & ~blank[1:] & ~blank[:-1]) + 1
    begins[changes[~mixed[np.searchsorted(chunks, changes, "right") - 1]]] = True
    for k in holders(data, bounds[1:]).tolist():
        begins[bounds[k] + 1 : bounds[k + 1]] = False
    begins[n] = True
    return np.flatnonzero(begins)


class Spaced:
    """Encodes texts of a tokenizer whose chunks begin with white space, many together."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.model = tokenizer, tokenizer.model
        self.clear()

    def clear(self) -> None:
        #: Parts met, by number; part k has ids[first[k] : first[k] + size[k]].
        self.numbers: dict[bytes, int] = {}
        self.ids, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def learn(self, parts: list[bytes]) -> None:
        """Remembers the ids of parts that are new: words by the library's model, others by the whole tokenizer."""
        words, others = [], []
        for part in parts:
            (words if WORD.fullmatch(part) else others).append(part)
        ids, sizes, tokenize = [], [], self.model.tokenize
        for word in LETTERS[np.frombuffer(b"\n".join(words), np.uint8)].tobytes().decode("utf-32-le").split("\n") if words else ():
            found = tokenize(word)
            sizes.append(len(found))
            ids += [t.id for t in found]
        for part in others:
            found = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
            sizes.append(len(found))
            ids += found
        size = np.array(sizes, np.int64)
        known = len(self.numbers)
        self.numbers.update(zip(words + others, range(known, known + len(parts)), strict=True))
        self.first = np.append(self.first, np.cumsum(size) - size + len(self.ids))
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, np.array(ids, np.uint32))
        self.held += sum(map(len, parts)) + 4 * len(ids)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has; data are their bytes, cut at bounds."""
        if len(self.numbers) > MEMO_CHUNKS or self.held > MEMO_BYTES:
            self.clear()
        at = tiles(data, bounds)
        parts = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        different = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if new := [p for p in different if p not in self.numbers]:
            self.learn(new)
        number = np.fromiter(map(self.numbers.__getitem__, different), np.int64, len(different))[parts.indices.to_numpy()]
        size = self.size[number]
        ends = np.append(0, np.cumsum(size))
        place = np.repeat(self.first[number] - ends[:-1], size)
        place += np.arange(len(place))
        return self.ids[place], np.diff(ends[np.searchsorted(at, bounds)])

    def long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one text of more than TOGETHER bytes."""
        cuts = [0]
        if not len(holders(data, np.array([len(data)]))):
            while found := CUT.search(data, cuts[-1] + TOGETHER):
                cuts.append(found.start())
        ids = np.concatenate([self.encode(data[a:b], np.array([0, b - a]))[0] for a, b in pairwise([*cuts, len(data)])])
        return ids, np.array([len(ids)])


class Encoder(dict):
    """Encodes texts to little-endian unsigned 32-bit ids; as a dictionary, it has the ids of chunks met."""

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            self.parting = parting(json.load(f))
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.spaced = Spaced(self.tokenizer)
        self.held = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, text: str) -> bytes:
        """The ids of what the tokenizer would part off and not part further."""
        if (known := self.words.get(text)) is not None:
            return known
        plain = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(plain)]
        found = self.words[text] = PACKS[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
        return found

    def chunk(self, text: str) -> bytes:
        if not (plain := PLAIN.fullmatch(text)):
            return self.whole(text)
        letters, signs = plain.groups()
        return (self.word(letters.lower()) if letters else b"") + (self.word(signs) if signs else b"")

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        ids = self[chunk] = self.word(text.lower()) if chunk.isalpha() else self.chunk(text)  # isalpha of bytes: ASCII letters
        self.held += len(chunk) + len(ids)
        return ids

    def bounded(self) -> None:
        if len(self) > MEMO_CHUNKS or self.held > MEMO_BYTES:
            self.clear()
            self.held = 0
        if len(self.words) > MEMO_CHUNKS * 2 // 3:
            self.words.clear()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if self.parting == "spaced":
            for ids, lengths in self.arrays(pa.array(texts, pa.string())):
                yield from (part.tobytes() for part in np.split(ids.astype("<u4"), np.cumsum(lengths)[:-1]))
            return
        for text in texts:
            self.bounded()
            if not self.parting or any(c in text for c in (SEPARATORS if text.isascii() else OTHER_SPACE)):
                yield self.whole(text)
                continue
            yield b"".join(map(self.__getitem__, text.encode().split()))

    def arrays(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts after others, and how many each of these has, until all texts are done; none is null."""
        if self.parting != "spaced":
            for at in range(0, len(texts), 500):
                found = list(self.encode(texts.slice(at, 500).to_pylist()))
                yield np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found])
            return
        texts = texts.cast(pa.large_binary())
        bounds, data = (np.frombuffer(b or b"", kind) for b, kind in zip(texts.buffers()[1:], (np.int64, np.uint8), strict=True))
        bounds, at = bounds[texts.offset : texts.offset + len(texts) + 1], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + TOGETHER, "right")) - 1)
            some = data[bounds[at] : bounds[to]]
            yield self.spaced.long(some) if len(some) > TOGETHER else self.spaced.encode(some, bounds[at : to + 1] - bounds[at])
            at = to


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file, so that a worker's later tasks know its chunks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
