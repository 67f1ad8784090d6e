"""Byte-level word splitting for the operators that work in Python."""

from __future__ import annotations

import string

_ASCII_WORD = (string.ascii_letters + string.digits).encode()
#: ASCII letters in lower case, digits and all bytes of non-ASCII characters stay; everything else becomes a space.
FOLD = bytes(
    b if b >= 0x80 or bytes([b]) in (bytes([x]) for x in _ASCII_WORD.lower()) else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
#: The corpus' separators, and no others, become spaces.
SPACED = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def folded(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and non-ASCII characters; only A-Z are lower-cased."""
    return encoded(text).translate(FOLD).split()


def folded_lower(text: str | None) -> list[bytes]:
    """As folded(), with all letters lower-cased first."""
    return encoded((text or "").lower()).translate(FOLD).split()


def spaced(text: str | None) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`, unchanged."""
    data = encoded(text)
    return [w for w in data.split(b" ") if w] if _plain(data) else [w for w in data.translate(SPACED).split(b" ") if w]


def _plain(data: bytes) -> bool:
    return not any(c in data for c in (b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
