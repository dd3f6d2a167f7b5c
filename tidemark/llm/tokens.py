"""Encoding of whole texts with a public tokenizer, piece by piece.

Both supported pre-tokenizers cut inside white space only at known places, so a text's ids are those of its
pieces in a row.  A piece is a word with the white space before it; the words of a piece are what the
tokenizer's model sees.  Each worker keeps the ids of some pieces and words it has met.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Pieces, and words of pieces, that a worker keeps in each of two generations; longer ones are not kept.
KEPT, KEPT_CHARS = 300_000, 40
SPACED = re.compile(r"\s*\S+|\s+$")
#: White space other than spaces and line ends.
OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: str.split() and \s take these for white space, the tokenizers do not.
OWN_SPACE = re.compile("[\x1c-\x1f]")
BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: Before a text's first piece, which has no space before it.
FIRST = "\x1c"
#: \p{L} and \p{N} of the characters below U+0100.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
CUT_OFF = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_WORDS = re.compile(rf"{CUT_OFF}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
PLAIN_WORDS = re.compile(rf"{CUT_OFF}|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> dict[int, int]:
    """The letter that byte-level models use for each byte: itself if printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + rest.index(b) for b in rest}


BYTE_LETTERS = byte_letters()
SPACE = chr(BYTE_LETTERS[ord(" ")])


class Kept(dict):
    """Ids by piece: at most two generations of KEPT entries, the older of which goes when the newer is full."""

    def __init__(self, find):
        self.find, self.older = find, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.find(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """ids of texts as little-endian bytes of ``dtype``; equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.normalizer, self.pre_tokenizer = self.tokenizer.model.tokenize, self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        before = told.get("pre_tokenizer") or {}
        kinds = [x["type"] for x in before.get("pretokenizers", [before])] if before else []
        changes = told.get("normalizer") or {}
        changes = [x["type"] for x in changes.get("normalizers", [changes])] if changes else []
        self.cut = None
        if told.get("truncation") is None and told.get("padding") is None and told.get("post_processor") is None and told["model"]["type"] == "BPE":
            if kinds == ["ByteLevel"] and not changes and before["use_regex"] and not before["add_prefix_space"]:
                self.cut, self.split = self._cut_spaced, BYTE_WORDS.findall
            elif kinds == ["Split", "ByteLevel"] and changes == ["NFC", "Replace", "Lowercase"] and before["pretokenizers"][0]["behavior"] == "Removed" and "[^\\s\\p{L}\\p{N}]" in before["pretokenizers"][0]["pattern"]["Regex"]:
                self.cut, self.split = str.split, lambda piece: PLAIN_WORDS.findall(piece.lower())
        self.special = re.compile("|".join(re.escape(x["content"]) for x in told.get("added_tokens", [])) or r"(?!)")
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.kind == "H" else "<u4")
        self.pieces, self.words = Kept(self._piece), Kept(self._word)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    @staticmethod
    def _cut_spaced(text: str) -> list[str]:
        """Pieces as keys: a word stands for itself after a space, one that begins with a line end for itself alone."""
        if "  " in text or " \n" in text or "\n\n\n" in text or "\n\n " in text or text[-1:] in " \n" or OTHER_SPACE.search(text):
            return [x[1:] if x[0] == " " and x[1:2].strip() else x if x[0] == "\n" and x[1:2].strip() else FIRST + x for x in SPACED.findall(text)]
        found = text.replace("\n", " \n").split(" ")
        found[0] = FIRST + found[0]
        return found

    def _word(self, word: str) -> bytes:
        """Ids of what the model sees as one word."""
        if word.isascii() and word.isprintable() and word[-1] != " ":  # as below, at less cost
            seen = SPACE + word[1:] if word[0] == " " else word
        else:
            seen = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array(self.kind, [x.id for x in self.tokenize(seen)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        spaced = self.cut is not str.split
        if piece.isascii() and piece.isalpha():
            return self.words[" " + piece if spaced else piece.lower()]
        if spaced:
            piece = piece[1:] if piece[:1] == FIRST else piece if piece[:1] == "\n" else " " + piece
        if not BEYOND_LATIN.search(piece):
            words = self.words
            return b"".join([words[w] for w in self.split(piece)])
        if self.normalizer:
            piece = self.normalizer.normalize_str(piece)
        return b"".join([array(self.kind, [x.id for x in self.tokenize(w)]).tobytes() for w, _ in self.pre_tokenizer.pre_tokenize_str(piece)])

    def encode(self, text: str) -> bytes:
        if self.cut is None or OWN_SPACE.search(text) or self.special.search(text):
            return self._plain(text)
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.cut(text)])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(x) for x in texts]

    def ids_of(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text and then ``end``."""
        last = np.array([end], self.dtype).tobytes()
        return [np.frombuffer(x + last, self.dtype) for x in self.encode_all(texts)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop what this worker keeps of other operators' tokenizers."""
    _encoders.clear()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
