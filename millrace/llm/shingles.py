"""Word-shingle sets as 64-bit hashes, and their HyperMinHash signatures, batch by batch in numpy."""

from __future__ import annotations

import numpy as np

REGISTERS, BANDS = 192, 32
MANTISSA = 10
_U = np.uint64
#: Of a byte: 0 for white space, else the byte with A-Z in lower case.
_LOWER = np.array([0 if b in (0x20, *range(0x09, 0x0E)) else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_ODD = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in order, and each text's number of words."""
    sizes = np.array([len(t) + 1 if t else 1 for t in texts], np.int64)
    raw = b"\n".join([t or b"" for t in texts]) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    low = _LOWER[data]
    # NUL is a character of a word; only white space parts words
    gap = (low == 0) & (data != 0)
    inside = ~gap
    head = inside.copy()
    head[1:] &= gap[:-1]
    heads = np.flatnonzero(head)
    if not len(heads):
        return np.zeros(0, _U), np.zeros(len(texts), np.int64)
    word = np.cumsum(head)[inside] - 1
    ends = np.flatnonzero(gap[1:] & inside[:-1]) + 1
    lengths = ends - heads
    place = np.flatnonzero(inside) - heads[word]
    most = int(lengths.max())
    powers = np.cumprod(np.append(_U(1), np.full(most, _U(0xD1342543DE82EF95))), dtype=_U)
    value = (low[inside].astype(_U) + _U(1)) * powers[place]
    starts = np.cumsum(lengths) - lengths
    hashes = mix(np.add.reduceat(value, starts) * _ODD + lengths.astype(_U))
    upto = np.cumsum(sizes)
    return hashes, np.diff(np.append(0, np.searchsorted(heads, upto)))


def sets(texts: list[bytes | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct k-word shingles, sorted, in one array, and each set's size.

    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words, counts = word_hashes(texts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    size = np.minimum(counts, k)[owner]
    h = size.astype(_U)
    for j in range(k):
        have = j < size
        h = np.where(have, mix(h * _ODD + words[np.minimum(first + j, max(len(words) - 1, 0))] if len(words) else h), h)
    order = np.lexsort((h, owner)) if len(h) else np.zeros(0, np.int64)
    h, owner = h[order], owner[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[keep], owner[keep]
    return h, np.bincount(owner, minlength=len(texts))


def signatures(h: np.ndarray, sizes: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """HyperMinHash registers of each set: 6 bits of leading zeros and MANTISSA bits after them.

    A hash names a register and holds a value; each register keeps its least value's code. A register
    without an element takes that of another one, the same trial order for all sets (densification),
    so two sets' registers agree with a probability of their Jaccard similarity whatever the sizes.
    """
    n = len(sizes)
    out = np.full(n * registers, np.iinfo(np.uint64).max, _U)
    if len(h):
        x = mix(h ^ _U(0x5851F42D4C957F2D))
        slot = np.repeat(np.arange(n), sizes) * registers + (x >> _U(32)).astype(np.int64) % registers
        np.minimum.at(out, slot, mix(x + _ODD) >> _U(1))
    out = out.reshape(n, registers)
    empty = out == np.iinfo(np.uint64).max
    whole = (sizes > 0) & empty.any(1)
    for row in np.flatnonzero(whole):
        have, need = ~empty[row], np.flatnonzero(empty[row])
        trial = 1
        while len(need):
            at = (mix(need.astype(_U) * _U(1 << 20) + _U(trial)) % _U(registers)).astype(np.int64)
            hit = have[at]
            out[row, need[hit]] = out[row, at[hit]]
            need, trial = need[~hit], trial + 1
    # 63-bit values: how many leading zeros, and the bits after the first one
    value = out | _U(1)
    exponent = np.frexp(value.astype(np.float64))[1]
    over = (_U(1) << np.minimum(exponent, 63).astype(_U)) <= value  # rounding up to the next power
    exponent = np.where(over, exponent + 1, exponent)
    exponent = np.where((value >> (np.maximum(exponent, 1) - 1).astype(_U)) == 0, exponent - 1, exponent)
    zeros = np.minimum(63 - exponent, 63)
    shift = np.maximum(exponent - 1 - MANTISSA, 0).astype(_U)
    mantissa = (value >> shift) & _U((1 << MANTISSA) - 1)
    return ((zeros.astype(_U) << _U(MANTISSA)) | mantissa).astype(np.uint16)


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of registers; different bands never share keys but by chance."""
    n, registers = sig.shape
    rows = registers // bands
    parts = sig.reshape(n, bands, rows).astype(_U)
    key = np.broadcast_to(np.arange(1, bands + 1).astype(_U) * _ODD, (n, bands)).copy()
    for j in range(rows):
        key = mix(key * _ODD + parts[:, :, j])
    return key.view(np.int64)


#: Chance that registers of disjoint sets agree: the integral of the squared density of a minimum over
#: code cells, which is 1 / (4 ln 4) of a cell's relative width.
COLLISION = 0.1803 / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two rows of registers each, freed of chance collisions."""
    share = (a == b).mean(1)
    return np.clip((share - COLLISION) / (1 - COLLISION), 0, 1)
