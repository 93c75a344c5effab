"""Folded text (NFKC, lower case, letters and digits only), alone and for whole Arrow batches."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence

import numpy as np


class _Kept(dict):
    """For each code point itself or, where its category is neither L nor N, nothing; filled as code points come."""

    def __missing__(self, c: int) -> int | None:
        self[c] = kept = c if unicodedata.category(chr(c))[0] in "LN" else None
        return kept


_KEPT = _Kept()


def fold(text: str | None) -> str:
    """Folded form of one text; null folds to the empty text."""
    return unicodedata.normalize("NFKC", text).lower().translate(_KEPT) if text else ""


@functools.cache
def _kept() -> np.ndarray:
    """For each code point, whether its category is L or N."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), bool, 0x110000)


def fold_codes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts of a batch: all code points in a row, and where each text starts (one more entry than texts).

    Lower case and the choice of characters are done for the whole batch; NUL parts the texts, and casing doesn't
    reach across it.
    """
    joined = "\0".join(unicodedata.normalize("NFKC", t.replace("\0", " ") if "\0" in t else t) if t else "" for t in texts)
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = _kept()[codes]
    row = np.cumsum(codes == 0)[kept]
    starts = np.zeros(len(texts) + 1, np.int64)
    if len(texts):
        np.cumsum(np.bincount(row, minlength=len(texts)), out=starts[1:])
    return codes[kept], starts


def to_codes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points and starts of texts as they are."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def to_texts(codes: np.ndarray, starts: np.ndarray) -> list[str]:
    whole = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return [whole[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (the SplitMix64 finalizer); the argument stays as it is."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sorted_unique(x: np.ndarray) -> np.ndarray:
    """Distinct values in order; a plain sort is many times faster here than hashing them."""
    x = np.sort(x)
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def pieces(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three-character pieces of folded texts, packed into 63 bits, with the number of their text.

    A text of one or two characters is one piece, itself; an empty text has none.
    """
    c = codes.astype(np.uint64)
    lengths = np.diff(starts)
    packed = np.zeros(len(c), np.uint64)
    if len(c) > 2:
        packed[:-2] = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    row = np.repeat(np.arange(len(lengths)), lengths)
    whole = np.arange(len(c)) < starts[1:][row] - 2
    short = np.flatnonzero((lengths > 0) & (lengths < 3))
    own = [(int(c[starts[i]]) << 21 | int(c[starts[i] + 1])) if lengths[i] == 2 else int(c[starts[i]]) for i in short.tolist()]
    if not len(short):
        return packed[whole], row[whole]
    return np.concatenate([packed[whole], np.array(own, np.uint64)]), np.concatenate([row[whole], short])


def piece_keys(packed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Distinct pieces of each text (at most 2**14 of them) in order: text number in the upper bits, 50 bits of hash below."""
    return sorted_unique(row.astype(np.uint64) << np.uint64(50) | mix(packed) >> np.uint64(14))


def likeness(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Shared distinct pieces divided by all distinct pieces, pair by pair; two empty texts are alike."""
    n = len(left)
    if not n:
        return np.zeros(0)
    pa, ra = pieces(*to_codes(left))
    pb, rb = pieces(*to_codes(right))
    a, b = piece_keys(pa, ra), piece_keys(pb, rb)
    both = np.sort(np.concatenate([a, b]))
    count = lambda keys: np.bincount((keys >> np.uint64(50)).astype(np.int64), minlength=n)
    shared = count(both[1:][both[1:] == both[:-1]])
    sizes = count(a) + count(b)
    return np.where(sizes == 0, 1.0, shared / np.maximum(sizes - shared, 1))
