"""Token ids of whole texts with the tokenizers library, each distinct word encoded once per worker.

A text is cut where its tokenizer always cuts, and a piece's ids are looked up: the ids equal those of the whole text.
`words` cuts at and drops blanks (for tokenizers that drop white space and case); `gaps` cuts before white space that
follows something else, so that pieces keep their leading white space (for byte-level tokenizers). White space here is
blank, tab, line feed and carriage return; a piece that ends in any other white space has the whole text encoded
instead. Texts of Latin-1 characters are cut at once by the tokenizer's own rule, whose units only need merging.
"""

from __future__ import annotations

import os
import re
from array import array
from operator import attrgetter

CUTS = {"words": r"[^ \t\n\r]+", "gaps": r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"}
_LETTER, _NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two kinds of tokenizers cut a text before they merge pairs, for Latin-1.
RULES = {
    "words": f"[{_LETTER}]+|{_SHORT}|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+",
    "gaps": f" ?[{_LETTER}]+|{_SHORT}| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+",
}
#: Characters on whose kind Unicode tables may differ; texts with one, or with any beyond Latin-1, take the other way.
ODD = bytes([*range(9), 11, 12, *range(14, 32), *range(0x7F, 0xA1), 0xAD])
#: A worker keeps the ids of at most twice so many pieces and units, of at most so many characters each.
KEPT_PIECES, KEPT_UNITS, KEPT_CHARS = 30_000, 120_000, 48


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_plain(text: str) -> bool:
    """Whether a text is of Latin-1 characters without ODD ones."""
    try:
        written = text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return len(written.translate(None, ODD)) == len(written)


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: themselves if they can be seen, else from U+0100 on."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Kept(dict):
    """A cache of two generations: when the younger is full it becomes the elder, from which what is used comes back."""

    most = KEPT_PIECES

    def __init__(self):
        super().__init__()
        self.elder: dict = {}

    def keep(self, key: str, ids: bytes) -> bytes:
        if len(key) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.elder = dict(self)
                self.clear()
            self[key] = ids
        return ids


class _Units(_Kept):
    """Ids of what the tokenizer's rule cuts out: its merges alone are left to do."""

    most = KEPT_UNITS

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.merge, self.letters = tokenizer, tokenizer.model.tokenize, byte_letters()
        self.blank, self.id = self.letters[32], attrgetter("id")

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, unit: str) -> bytes:
        if (ids := self.elder.pop(unit, None)) is None:
            if unit.isascii() and unit.isprintable():
                written = unit.replace(" ", self.blank)
            else:
                written = unit.encode().decode("latin-1").translate(self.letters)
            ids = array("I", map(self.id, self.merge(written))).tobytes()
        return self.keep(unit, ids)


class _Pieces(_Kept):
    """Ids of what lies between cuts."""

    def __init__(self, units: _Units):
        super().__init__()
        self.units = units

    def __missing__(self, piece: str) -> bytes:
        if (ids := self.elder.pop(piece, None)) is not None:
            return self.keep(piece, ids)
        if piece[-1] not in " \t\n\r" and piece[-1].isspace():
            raise LookupError
        return self.keep(piece, self.units.encode(piece))


class Encoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers, followed by the end id."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, path: str, cut: str, end_id: int | None, kept: int = KEPT_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.units = _Units(tokenizer)
        self.units.most = kept
        self.pieces, self.find = _Pieces(self.units), re.compile(CUTS[cut]).findall
        self.rule, self.lower = re.compile(RULES[cut]).findall, cut == "words"
        self.end = b"" if end_id is None else end_id.to_bytes(4, "little")

    @classmethod
    def of(cls, path: str, cut: str, end_id: int | None, kept: int = KEPT_UNITS) -> Encoder:
        """One for each worker process. kept: it keeps the ids of at most twice so many units."""
        if (key := (path, cut, end_id, kept)) not in cls._made:
            cls._made[key] = cls(path, cut, end_id, kept)
        return cls._made[key]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return self.end
        if is_plain(text):
            return b"".join(map(self.units.__getitem__, self.rule(text.lower() if self.lower else text))) + self.end
        try:
            return b"".join(map(self.pieces.__getitem__, self.find(text))) + self.end
        except LookupError:
            return self.units.encode(text) + self.end
