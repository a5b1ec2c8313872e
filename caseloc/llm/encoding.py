"""Byte-level BPE encoding of whole texts, one distinct word at a time.

The pre-tokenizer of the byte-level tokenizers never joins characters across
the start of a line break that stands alone, or across a single space that has
a non-space character on either side. A text is cut there, each distinct piece
is encoded once by the ``tokenizers`` library, and the ids of the pieces are
joined. Texts with other white space are cut by a slower rule, at the single
spaces only.
"""

from __future__ import annotations

import functools
import re

import numpy as np

_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Letters below this code point are letters in every version of Unicode.
_LATIN_END = "\u0250"
_WORD_AND_MARKS = re.compile(r"([^\W\d_]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+)")


class Ragged(Exception):
    """The text has white space that the quick cut does not cover."""


class _Pieces(dict):
    """piece -> its ids as little-endian 32-bit integers; bounded."""

    def __init__(self, owner: "WordEncoder", lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise Ragged
        if piece.isalpha() and max(piece) < _LATIN_END:
            ids = self.owner.word(self.lead + piece)
        elif found := _WORD_AND_MARKS.fullmatch(piece):
            ids = self[found[1]] + self.owner.first[found[2]]
        else:
            ids = self.owner.plain(self.lead + piece)
        if len(piece) <= 40 and len(self) < self.owner.keep:
            self[piece] = ids
        return ids


def _shown_bytes() -> dict[int, int]:
    """Byte -> the character that stands for it in a byte-level vocabulary:
    itself if it is printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}


class WordEncoder:
    def __init__(self, path: str, keep: int = 700_000, special: bool = False):
        """path: a ``tokenizers`` JSON file with a byte-level pre-tokenizer that
        adds no leading space. keep: pieces kept in memory, for each kind.
        special: a special token's text has that token's id, as by default in
        the library; else it is text like any other."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder().values() if special else ()
        self.special = [t.content for t in added]
        self.keep = keep
        self.shown = _shown_bytes()
        self.first, self.rest = _Pieces(self, ""), _Pieces(self, " ")
        self.line_break = self.plain("\n")

    def word(self, text: str) -> bytes:
        """Letters with a space before them or not: one piece of the
        pre-tokenizer, so the model can encode it without the steps around it."""
        shown = text.encode().decode("latin-1").translate(self.shown)
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], dtype="<u4").tobytes()

    def plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self.plain(text)
        first, rest = self.first, self.rest
        try:
            lines = []
            for line in text.split("\n"):
                words = line.split(" ")
                lines.append(first[words[0]])
                if len(words) > 1:
                    lines[-1] += b"".join([rest[w] for w in words[1:]])
            return self.line_break.join(lines)
        except Ragged:
            return self._slow(text)

    def _slow(self, text: str) -> bytes:
        head, *tail = _SINGLE_SPACE.split(text)
        out = [self.plain(head)]
        for piece in tail:
            try:
                out.append(self.rest[piece])
            except Ragged:
                out.append(self.plain(" " + piece))
        return b"".join(out)


@functools.cache
def word_encoder(path: str, special: bool = False) -> WordEncoder:
    """One encoder for each Python worker."""
    return WordEncoder(path, special=special)


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
