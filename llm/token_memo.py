"""Encoding of whole texts piece by piece with a bounded memory of pieces.

The tokenizers handled here never build a token across ASCII white space, so a
text's ids are those of its pieces in a row.  ``PieceMemo`` keeps the ids of the
pieces seen lately in two generations: when the young one is full it becomes
the old one, and what was not used since is forgotten.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

#: Pieces kept in each generation (about 30 MB).
MEMO_PIECES = 150_000
#: Longer pieces are encoded anew each time.
MEMO_LENGTH = 48
_TAIL = b".,;:!?*#$%&|"
_ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")


class PieceMemo:
    """ids of a text as little-endian bytes of ``dtype``; ``encode`` gives the ids of one piece."""

    def __init__(self, encode: Callable[[bytes], list[int]], dtype: type, special: bytes = b"<|") -> None:
        self.encode, self.dtype, self.special = encode, dtype, special
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _piece(self, piece: bytes, whole: bool = False) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            head = piece.rstrip(_TAIL)
            # A cut after an ASCII letter or digit and before ASCII punctuation is a cut between tokens.
            if not whole and head and len(head) < len(piece) and head[-1] in _ALNUM:
                ids = (self.young.get(head) or self._piece(head)) + self._tail(piece[len(head) :])
            else:
                ids = np.array(self.encode(piece), dtype=self.dtype).tobytes()
        if len(piece) <= MEMO_LENGTH:
            if len(self.young) >= MEMO_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def _tail(self, tail: bytes) -> bytes:
        return self.young.get(tail) or self._piece(tail, True)

    def ids(self, text: bytes) -> bytes:
        if self.special in text:
            # Strings of special tokens keep their case and their neighbours.
            return b"".join([np.array(self.encode(p), dtype=self.dtype).tobytes() for p in text.split()])
        get = self.young.get
        return b"".join([get(p) or self._piece(p) for p in text.lower().split()])


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(kept)]
    chars = {b: chr(b) for b in kept} | {b: chr(0x100 + i) for i, b in enumerate(others)}
    return [chars[b] for b in range(256)]


def lowered(text: str) -> str:
    """Lower case character by character, without the rule for a word's last sigma."""
    return "".join([c.lower() for c in text]) if "Σ" in text else text.lower()


def plain_word(piece: bytes) -> str | None:
    """The normalised piece if it is made of letters only, else None."""
    try:
        text = piece.decode()
    except UnicodeDecodeError:
        return None
    if not text.isalpha():
        return None
    text = lowered(unicodedata.normalize("NFC", text))
    return text if text.isalpha() else None
