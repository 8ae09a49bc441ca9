"""Exact tokenizer encoding of whole texts through a bounded cache of pieces.

Each split below cuts a text only where its tokenizer never joins what stands on both sides, so the ids of a text are the
ids of its pieces one after another. The library encodes each piece that a worker meets for the first time, many at once;
pieces that come again cost a look-up. A cache is bounded in bytes and lives for one stage of a worker; what it drops changes
time and never results.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import regex

from granulo.llm.common import held

#: Most bytes in each of the two halves of a cache, what an entry costs beside its piece and value, and the longest piece that
#: is kept; one with a newline hardly comes again.
HALF_BYTES, ENTRY_BYTES, KEPT_BYTES = 24 << 20, 180, 24
_SPACES = rb"\t\n\x0b\x0c\r\x1c-\x20"
#: A space before a blank of any kind, or at the end.
_BEFORE_BLANK = re.compile(rb" (?:[" + _SPACES + rb"]|$|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)")
_CUT = re.compile(rb"(?= (?![" + _SPACES + rb"]|$|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80))")
_RUNS = re.compile(rb" *[^ ]+| +")


def split_blank(data: bytes) -> list[bytes]:
    """For tokenizers that drop blanks: what stands between ASCII blanks."""
    return data.split()


def split_byte_level(data: bytes) -> tuple[list[bytes], list[bytes]]:
    """For byte-level tokenizers whose words take one space before them: cut before each space that a non-blank follows.

    Blanks before such a space are a word of their own with or without the cut. Returns the first piece, if any, and the
    others without the space that each begins with; a first piece that begins with a space counts among the others.
    """
    if _BEFORE_BLANK.search(data):
        rest = [x for x in _CUT.split(data) if x]
        lead = [] if rest[0][0] == 32 and len(rest[0]) > 1 and not _BEFORE_BLANK.match(rest[0]) else [rest.pop(0)]
        return lead, [x[1:] for x in rest]
    first, *rest = data.split(b" ")
    return ([first] if first else []), rest


def split_marked(data: bytes) -> list[bytes]:
    """For pieces with the space marker at their start only: cut before each run of spaces."""
    if b"  " in data or data[-1:] == b" ":
        return _RUNS.findall(data)
    first, *rest = data.split(b" ")
    return ([first] if first else []) + [b" " + x for x in rest]


class Pieces(dict):
    """Values by piece, made when first asked for. Two halves: when the newer is full it becomes the older, which is dropped."""

    def __init__(self, make, half_bytes: int | None = None):
        super().__init__()
        self.make, self.most, self.older = make, half_bytes or HALF_BYTES, {}
        self.bytes = 0

    def __missing__(self, piece: bytes):
        value = self.older.get(piece)
        if value is None:
            value = self.make(piece)
            if len(piece) > KEPT_BYTES or b"\n" in piece:
                return value
        if self.bytes >= self.most:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self.bytes += ENTRY_BYTES + len(piece) + len(value)
        self[piece] = value
        return value


class PieceCache:
    """As ``Pieces``, with many new pieces made at once. An entry counts 480 bytes: two byte strings, a tuple and its place."""

    COST = 480

    def __init__(self, make, half_bytes: int | None = None):
        self.make, self.known, self.older, self.long = make, {}, {}, []
        self.most = (half_bytes or HALF_BYTES) // self.COST

    def __call__(self, pieces: list[bytes]) -> dict[bytes, tuple]:
        """The values of these pieces at least, until the next call; long ones are dropped then."""
        for x in self.long:
            del self.known[x]
        self.long = []
        wanted = set(pieces)
        new = wanted - self.known.keys()
        if new:
            if len(self.known) + len(new) > self.most:
                self.older, self.known = self.known, {x: self.known[x] for x in wanted - new}
            back = new & self.older.keys()
            self.known.update((x, self.older[x]) for x in back)
            made = list(new - back)
            self.known.update(zip(made, self.make(made)))
            self.long = [x for x in made if len(x) > KEPT_BYTES]
        return self.known


def library(path: str):
    """The tokenizer of a file, special strings in texts being ordinary text. One for the tasks of a stage in a worker."""

    def load():
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        t.encode_special_tokens = True
        return t

    return held(("library", path), load)


def _splitter(path: str):
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre = told["pre_tokenizer"] or {}
    if told["model"]["type"] == "BPE" and not told["normalizer"] and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return split_byte_level
    step = (pre.get("pretokenizers") or [{}])[0]
    if step.get("type") == "Split" and step.get("invert") and step.get("behavior") == "Removed" and str(step.get("pattern", {}).get("Regex")).endswith(r"[^\s\p{L}\p{N}]+"):
        return split_blank
    return None


# Fixed value: how byte-level tokenizers cut a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this one are the same to every version of the Unicode tables, and composed already.
LATIN = "\u0250"


def byte_characters() -> dict[int, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers, an end id after each text if ``end`` is given.

    A new piece of Latin letters and marks is cut into words here and its words go to the library's merge model; any other
    goes through the whole library.
    """

    def __init__(self, path: str, end: int | None = None, half_bytes: int | None = None):
        self.tokenizer, self.split = library(path), _splitter(path)
        self.end = b"" if end is None else np.array([end], "<u4").tobytes()
        self.plain, self.spaced = Pieces(self._ids, half_bytes), Pieces(self._spaced, half_bytes)
        self.model, self.shown = self.tokenizer.model, byte_characters()
        self.space = chr(self.shown[32])
        self.lower = self.split is split_blank
        pattern = WORDS
        if self.lower:
            with open(path, encoding="utf-8") as f:
                told = json.load(f)
            pattern = told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            steps = [(n["type"], n.get("content")) for n in told["normalizer"]["normalizers"]]
            if steps != [("NFC", None), ("Replace", " "), ("Lowercase", None)]:
                self.shown = None
        self.words = regex.compile(pattern).findall

    def _word(self, start: str, word: str) -> bytes:
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.model.tokenize(start + shown)]).tobytes()

    def _spaced(self, piece: bytes) -> bytes:
        """Ids of a space and a piece: mostly one word, or a word with a mark behind."""
        if piece.isalpha():
            return self._word(self.space, piece.decode())
        if piece[-1:] in (b".", b",") and piece[:-1].isalpha():
            return self.spaced[piece[:-1]] + self.plain[piece[-1:]]
        return self._ids(b" " + piece)

    def _ids(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.split is None or self.shown is None or not text or max(text) >= LATIN:
            return array("I", self.tokenizer.encode(text, None, False, False).ids).tobytes()
        words = self.words(text.lower() if self.lower else text)
        if len(words) == 1:
            word = words[0]
            return self._word("", word) if word.isalpha() else array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()
        return b"".join([self.spaced[w[1:].encode()] if w[0] == " " and len(w) > 1 else self.plain[w.encode()] for w in words])

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        plain, spaced, out = self.plain.__getitem__, self.spaced.__getitem__, []
        for t in texts:
            if not t:
                out.append(self.end)
            elif self.split is split_byte_level:
                lead, rest = split_byte_level(t.encode())
                out.append(b"".join([*map(plain, lead), *map(spaced, rest), self.end]))
            elif self.split is split_blank:
                out.append(b"".join([*map(plain, t.encode().split()), self.end]))
            else:
                out.append(self._ids(t.encode()) + self.end)
        return out


def encoder(path: str, end: int | None = None, half_bytes: int | None = None) -> Encoder:
    """The encoder that a worker's tasks of one stage share."""
    return held(("encoder", path, end), lambda: Encoder(path, end, half_bytes))


class SpanEncoder:
    """For whole texts: how many tokens each has, and every token's first and one past its last code point in its text.

    A byte-level vocabulary says how many bytes each id stands for, so the ids of a text tell where its tokens are; a token that
    begins or ends inside a character has all of it, as the library's offsets do. Other tokenizers encode whole texts in the
    library, many at once.
    """

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.sizes = None
        if self.encoder.split is split_byte_level:
            vocabulary = self.encoder.tokenizer.get_vocab()
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, i in vocabulary.items():
                self.sizes[i] = len(token)  # one character stands for each byte

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.sizes is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            found = self.encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
            spans = np.array([s for e in found for s in e.offsets], np.int64).reshape(-1, 2)
            return np.array([len(e.ids) for e in found], np.int64), spans[:, 0], spans[:, 1]
        ids = self.encoder(texts)
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        size = self.sizes[np.frombuffer(b"".join(ids), "<u4")]
        last = np.cumsum(size)
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte, over all texts
        chars = np.array([len(t) for t in texts], np.int64)
        base = np.repeat(np.cumsum(chars) - chars, counts)
        return counts, character[last - size] - base, character[last - 1] + 1 - base


def span_encoder(path: str) -> SpanEncoder:
    return held(("spans", path), lambda: SpanEncoder(path))
