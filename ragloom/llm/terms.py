"""Terms of whole texts: runs of ASCII digits and letters and of everything beyond ASCII, with only A-Z in lower case."""

from __future__ import annotations

import string
from collections.abc import Iterator

#: Longer texts are split into terms piece by piece.
PIECE = 1 << 20

_KEPT = string.digits + string.ascii_lowercase
_TABLE = bytes(b if b >= 128 or chr(b) in _KEPT else ord(chr(b).lower()) if chr(b) in string.ascii_uppercase else 32 for b in range(256))


def runs(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of UTF-8 bytes in order, in lists of about `piece` bytes; no term is cut."""
    clean = raw.translate(_TABLE)
    if len(clean) <= piece:
        yield clean.split()
        return
    at = 0
    while at < len(clean):
        end = clean.find(b" ", at + piece)
        end = len(clean) if end < 0 else end
        yield clean[at:end].split()
        at = end
