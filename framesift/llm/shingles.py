"""Word shingles of whole texts as sorted sets of 64-bit values, and MinHash signatures, vectorised with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A text's set holds its distinct shingles of five words; a text
with fewer words has its whole sequence as the one member; a text without words has the empty set. A shingle's value is
a mix of its words' 64-bit hashes: two different shingles share a value with a chance of about 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 1 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_LONG_WORD = 256
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64 for i < n."""
    size = max(CHUNK * 2, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for b in (_BASE, inverse):
            t = np.full(size, b, U)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[size] = tuple(tables)
    return _powers[size]


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``, which ends with a space."""
    a = np.frombuffer(data, np.uint8)
    space = (a == 32) | ((a >= 9) & (a <= 13))
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(a))
    total = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * power[: len(a)], out=total[1:])
    h = _mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(ends - starts >= _LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h, starts


def _combined(w: np.ndarray, n: int, size: int) -> np.ndarray:
    """Values of all windows of n words."""
    out = np.full(max(0, len(w) - n + 1), (size * 0xA0761D6478BD642F + n * 0xE7037ED1A0B428DB) & _MASK, U)
    for k in range(n):
        out = _mixed((out ^ w[k : len(w) - n + 1 + k]) * U(((2 * k + 3) * 0x8EBC6AF09C88C6E3 | 1) & _MASK))
    return out


def shingle_sets(texts: list[str | None], n: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of every text, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < CHUNK):
            size += len(raw[end]) + 1
            end += 1
        w, starts = _word_hashes(b" ".join(raw[at:end]) + b" ")
        offsets = np.cumsum([0] + [len(x) + 1 for x in raw[at:end]])
        bounds = np.searchsorted(starts, offsets)
        windows = _combined(w, n, n)
        for first, last in zip(bounds[:-1], bounds[1:]):
            if last - first >= n:
                yield np.unique(windows[first : last - n + 1])
            elif last > first:
                yield _combined(w[first:last], int(last - first), n)
            else:
                yield np.empty(0, U)
        at = end


def constants(k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(seed))
    draw = lambda: r.integers(0, 1 << 63, k, dtype=np.uint64) * U(2) + U(1)
    return draw(), draw()


def signatures(sets: list[np.ndarray], k: int, bits: int) -> np.ndarray:
    """b-bit MinHash symbols, a row of ``k`` for each set; zeros for an empty set."""
    out = np.zeros((len(sets), k), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    xor, mul = constants(k)
    group: list[int] = []
    for place, i in enumerate(full):
        group.append(i)
        if sum(len(sets[j]) for j in group) < 20_000 and place + 1 < len(full):
            continue
        values = np.concatenate([sets[j] for j in group])
        cuts = np.cumsum([0] + [len(sets[j]) for j in group[:-1]])
        for c in range(k):
            least = np.minimum.reduceat((values ^ xor[c]) * mul[c], cuts)
            out[group, c] = _mixed(least) >> U(64 - bits)
        group = []
    return out


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One byte per bin of the value range: 0 for no member in the bin, else a hash of the bin's least member."""
    out = np.zeros((len(sets), bins), np.uint8)
    shift = U(64 - (bins - 1).bit_length())
    for i, s in enumerate(sets):
        b = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        out[i, b[first]] = (_mixed(s[first] ^ U(0x5851F42D4C957F2D)) % U(255) + U(1)).astype(np.uint8)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small):
        return 0, len(large)
    at = np.searchsorted(large, small)
    both = int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))
    return both, len(a) + len(b) - both
