"""Whole-text token ids through the ``tokenizers`` library, remembered by chunk of text.

BPE never merges across the boundary between a visible character and a blank or line feed that follows
it, so a text is cut there and a chunk that was seen before isn't encoded again. The ids are those of
encoding the whole text at once (the tests compare the two).
"""

from __future__ import annotations

import os
import re
import struct
from operator import attrgetter

from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a Spark task has one core

#: A chunk: leading white space, visible characters, and white space that doesn't begin with a blank or line feed.
CHUNK = re.compile(r"\s*\S+(?:(?![ \n])\s+\S*)*|\s+")
#: Marks that stand apart from the letter before them in every vocabulary, and in no special token's name.
CLOSING = ".,!?;:$#%&*"
#: Letters of which neither normal form nor lower case depends on what is beside them.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿА-Яа-я]+")
#: White space other than blank and line feed.
OTHER_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Pieces remembered in each of two generations, some 200 bytes each.
KEEP = 450_000
#: Longer pieces are encoded each time, so that the memory's size in bytes is bounded too.
LONGEST_KEPT = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


BYTE_LETTERS = byte_letters()
_id = attrgetter("id")
PROBE = ("Probe", "was", "Übung", "a", "thonerea", "é", "der", "ÇA", "Ёлка", "ДЫМ")
_PACKED = [struct.Struct(f"<{n}I").pack for n in range(33)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else struct.pack(f"<{len(ids)}I", *ids)


class ChunkCodes(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers.

    A piece that begins with a visible character stands for that text after one blank. Two generations
    of at most ``keep`` pieces each are remembered, so rare pieces are forgotten and memory is bounded. The name of a
    special token in a text gives that token, as in the library, or with ``names_as_text`` the ids of its letters.
    """

    def __init__(self, path: str, keep: int = KEEP, names_as_text: bool = False):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = names_as_text
        self.model = self.tokenizer.model
        self.word, self.letters = self.plain_words()
        # Whether a line feed before a visible character does what a blank does.
        self.blind = all(self.plain("\n" + w) == self.plain(" " + w) for w in (*PROBE, "!", "7", "'s", "é"))
        self.keep, self.older = keep, {}

    def plain_words(self):
        """The forms in which the model itself takes one word of ASCII letters and one of ``LETTERS``, if they give what the whole tokenizer gives; else None."""
        forms = {
            "blank": lambda word: (" " + word).encode().decode("latin-1").translate(BYTE_LETTERS),
            "lower": lambda word: word.lower().encode().decode("latin-1").translate(BYTE_LETTERS),
        }
        # ASCII letters stand for themselves.
        plain = {"blank": (BYTE_LETTERS[32] + "{}").format, "lower": str.lower}
        for name, form in forms.items():
            if all([*map(_id, self.model.tokenize(form(w)))] == self.plain(" " + w) for w in PROBE):
                return plain[name], form
        return None, None

    def plain(self, text: str) -> list[int]:
        # The call for batches that leaves out offsets; the ids are the same.
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def __missing__(self, piece: str) -> bytes:
        code = self.older.get(piece)
        if code is None:
            if piece[0] in " \n":
                if self.blind and len(piece) > 1 and piece[0] == "\n" and not piece[1].isspace():
                    return self[piece[1:]]
                ids = self.plain(piece)
            elif self.word and piece.isascii() and piece.isalpha():
                ids = [*map(_id, self.model.tokenize(self.word(piece)))]
            elif self.word and LETTERS.fullmatch(piece):
                ids = [*map(_id, self.model.tokenize(self.letters(piece)))]
            else:
                word = piece.rstrip(CLOSING)
                # A letter may be no letter in lower case: U+0130 ends in a mark then, which joins the closing ones.
                if word and len(word) < len(piece) and word[-1].isalpha() and word[-1].lower()[-1].isalpha():
                    known = word in self
                    code = self[word] + self.closing(piece[len(word) :])
                    if not known:  # a new word: its closed form is worth a place only when it comes again
                        return code
                else:
                    ids = self.plain(" " + piece)
            if code is None:
                code = packed(ids)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= self.keep:
                self.older = dict(self)
                self.clear()
            self[piece] = code
        return code

    def closing(self, marks: str) -> bytes:
        """Marks that follow a letter, kept under a name that no piece has."""
        name = "\n" + marks + " "
        code = self.get(name)
        if code is None:
            code = packed(self.plain(marks))
            if len(name) <= LONGEST_KEPT:
                self[name] = code
        return code

    def raw(self, chunk: str) -> bytes:
        """Ids of a chunk as it stands."""
        if chunk[0] == "\n" or len(chunk) > 1 and chunk[0] == " " and not chunk[1].isspace():
            return self[chunk[1:] if chunk[0] == " " else chunk]
        return packed(self.plain(chunk))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text is an empty one."""
        if not text:
            return b""
        flat = text.replace("\n", " ")
        # White space at an end, several in a row, or of another kind.
        if flat[0] == " " or flat[-1] == " " or "  " in flat or any(c in flat for c in OTHER_WHITE):
            return b"".join(map(self.raw, CHUNK.findall(text)))
        first, *pieces = text.replace("\n", " \n").split(" ")
        return self.raw(first) + b"".join(map(self.__getitem__, pieces))


_CODES: dict[tuple[str, int, bool], ChunkCodes] = {}


def codes_for(path: str, keep: int = KEEP, names_as_text: bool = False) -> ChunkCodes:
    """One memory of chunks per Python worker; another tokenizer or size takes its place."""
    wanted = (path, keep, names_as_text)
    if wanted not in _CODES:
        _CODES.clear()
        _CODES[wanted] = ChunkCodes(*wanted)
    return _CODES[wanted]


def forget() -> None:
    _CODES.clear()
