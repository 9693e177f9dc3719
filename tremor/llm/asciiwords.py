"""Words of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased:
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text, as UTF-8."""

from __future__ import annotations

from collections.abc import Iterator

# A byte beyond ASCII belongs to a code point beyond ASCII, so bytes tell words apart.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PIECE = 1 << 20


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def pieces(text: str | None, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, of about ``size`` bytes at a time, so that a very
    long text is never held as one list of words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    lo = 0
    while lo < len(raw):
        hi = raw.find(b" ", lo + size)
        hi = len(raw) if hi < 0 else hi
        found = raw[lo:hi].split()
        if found:
            yield found
        lo = hi
