"""Words of many texts at once, as 64-bit hashes in numpy arrays, straight from an Arrow column's buffers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from quire.llm.common import forget, tidy

_U = np.uint64
_PRIME = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_PRIME, -1, 1 << 64)
SPACE, WORD, SIGN, UNSPACED = 0, 1, 2, 3
#: Fixed value: blocks of scripts that write no spaces between words (Han, kana, Thai, Lao, Khmer, Myanmar).
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x302F), (0x3038, 0x303C), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)


def words_only() -> np.ndarray:
    """Bytes by class: white space (0x20, 0x09-0x0D) and all else."""
    out = np.full(256, WORD, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    return out


def words_and_signs() -> np.ndarray:
    """Bytes by class: white space, letters and digits (with all bytes from 0x80 on), and signs."""
    out = words_only()
    out[:128][out[:128] == WORD] = SIGN
    for a, b in ("09", "AZ", "az"):
        out[ord(a) : ord(b) + 1] = WORD
    return out


@lru_cache
def code_points() -> np.ndarray:
    """Code points by class: white space, letters, digits and marks, signs, and letters that are words by themselves.

    Up to 0x7F as words_and_signs. Variation selectors and format characters are signs; joiners belong to words.
    """
    kinds = {"Z": SPACE, "P": SIGN, "S": SIGN, "Cc": SIGN, "Cf": SIGN}
    out = np.full(0x110000, WORD, np.uint8)
    of = [unicodedata.category(chr(i)) for i in range(0x20000)]
    out[:0x20000] = [kinds.get(c, kinds.get(c[0], WORD)) for c in of]
    for a, b in _UNSPACED:
        part = out[a : b + 1]
        part[part == WORD] = UNSPACED
    out[0xFE00:0xFE10] = out[0xE0000:0xE1000] = SIGN
    out[0x85], out[[0x200C, 0x200D]] = SPACE, WORD
    out[:128] = words_and_signs()[:128]
    return out


def _kinds(data: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's class by its code point in UTF-8, and the bytes that begin a code point of class UNSPACED."""
    kind = classes[data]
    if not len(wide := np.flatnonzero(data >= 0x80)):
        return kind, wide
    kind[wide] = WORD
    lead = wide[data[wide] >= 0xC0]
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = (data[lead] & (0x7F >> size)).astype(np.int64)
    rest = []
    for k in range(1, 4):
        at = np.minimum(lead + k, len(data) - 1)
        more = (size > k) & (data[at] & 0xC0 == 0x80)
        code = np.where(more, code << 6 | data[at] & 0x3F, code)
        rest.append((at, more))
    mine = classes[np.minimum(code, len(classes) - 1)]
    kind[lead] = mine
    for at, more in rest:
        kind[at[more]] = mine[more]
    return kind, lead[mine == UNSPACED]


def lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the prime and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 19)
        for name, by in (("up", _PRIME), ("down", _INVERSE)):
            step = np.full(size, by, _U)
            step[0] = 1
            _powers[name] = np.cumprod(step, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


@dataclass
class Words:
    """Words of some texts: hash, first byte and the byte behind the last of each word, and each text's first word."""

    data: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    kinds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.firsts)

    @property
    def texts(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.firsts) - 1), self.counts)

    def beginnings(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first n bytes of the words that have more, and which words these are."""
        at = np.flatnonzero(self.ends - self.starts > n)
        s = self.starts[at]
        return mix((self.sums[s + n] - self.sums[s]) * powers(len(self.data))[1][s] + _U(n)), at


def split(data: np.ndarray, bounds: np.ndarray, classes: np.ndarray, fold: np.ndarray) -> Words:
    """data: the texts' bytes in a row; bounds: where each begins, and the end; classes: of the 256 bytes, or of code points."""
    n = len(data)
    kind, alone = (classes[data], None) if len(classes) == 256 else _kinds(data, classes)
    new = np.ones(n, bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[bounds[bounds < n]] = True
    if alone is not None:
        new[alone] = True
    edges = np.flatnonzero(new)
    behind = np.append(edges[1:], n)
    real = kind[edges] != SPACE
    starts, ends = edges[real], behind[real]
    up, down = powers(max(n, 1))
    sums = np.zeros(n + 1, _U)
    np.cumsum((fold[data].astype(_U) + _U(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    return Words(data, bounds, sums, hashes, starts, ends, np.searchsorted(starts, bounds), np.where(kind[starts] == UNSPACED, WORD, kind[starts]))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column without nulls."""
    import pyarrow as pa

    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def runs(column, classes: np.ndarray, fold: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int, Words]]:
    """(from, to, their Words) for runs of the column's texts of about `most` bytes; a longer text is a run of its own."""
    forget()
    data, at = buffers(column)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, split(data[at[i] : at[j]], at[i : j + 1] - at[i], classes, fold)
        i = j
    if len(column) > 1:
        tidy()


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and each run's first word."""
    m = len(w.hashes)
    if m < n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = w.hashes[: m - n + 1].copy()
    for k in range(1, n):
        h *= _U(0xFF51AFD7ED558CCD)
        h += w.hashes[k : m - n + 1 + k]
        h ^= h >> _U(32)
    left = np.repeat(w.firsts[1:], w.counts)[: m - n + 1] - np.arange(m - n + 1)
    at = np.flatnonzero(left >= n)
    return mix(h[at]), at


def keep(w: Words, mask: np.ndarray) -> Words:
    """The same texts with only the words that mask names."""
    before = np.append(0, np.cumsum(mask))
    return Words(w.data, w.bounds, w.sums, w.hashes[mask], w.starts[mask], w.ends[mask], before[w.firsts], w.kinds[mask])
