"""Words of many texts at once, as 64-bit hashes, with numpy over Arrow buffers.

A prefix sum of (random value of a byte) * (power of its position) gives the
polynomial hash of any range of bytes with two look-ups, so no Python code
runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_P = 0x9E3779B97F4A7C15
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256).astype(U) | U(1)
_POW: dict[str, np.ndarray] = {"p": np.ones(1, U), "i": np.ones(1, U)}
#: Primes and bases of a second hash: modulo 2^64 alone, words made for it (such as long ones of two letters that mirror each other) are known to collide.
_PRIMES = ((2**31 - 1, 1_103_515_245), (2**31 - 19, 1_664_525_003))
_PRIME_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes of text handled at once, so that the working arrays stay small; a longer text is one slice.
SLICE = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n:
        for k, base in (("p", _P), ("i", pow(_P, -1, 2**64))):
            out = np.full(n, base, U)
            out[0] = 1
            _POW[k] = np.multiply.accumulate(out)
    return _POW["p"], _POW["i"]


def _prime_powers(prime: int, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo a prime, by doubling."""
    known = _PRIME_POW.get(prime)
    if known is None or len(known[0]) < n:
        out = []
        for b in (base % prime, pow(base, -1, prime)):
            powers = np.ones(1, np.int64)
            while len(powers) < n:
                powers = np.concatenate((powers, powers * pow(b, len(powers), prime) % prime))
            out.append(powers)
        known = _PRIME_POW[prime] = (out[0], out[1])
    return known


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of a slice of texts: bytes (A-Z lowered), doc (index of the text), start, end (byte after), hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.n_docs, self.offsets, self.raw = len(offsets) - 1, offsets, raw
        b = self.bytes = np.where((raw >= 65) & (raw <= 90), raw | np.uint8(32), raw)
        space = self.space = (b == 32) | ((b >= 9) & (b <= 13))
        cut = np.zeros(len(b) + 1, bool)
        cut[offsets] = True
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1] | cut[1:-1]
        ends[:-1] &= space[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        p, self._inv = _powers(max(SLICE, len(b)) + 1)
        self._sum = np.zeros(len(b) + 1, U)
        np.cumsum(_TABLE[b] * p[: len(b)], out=self._sum[1:])
        self.hash = self.part(self.start, self.end)
        #: Index of the first word of each text, and the number of words at the end.
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def strong(self) -> np.ndarray:
        """Hashes of the words from hash and from polynomials modulo two primes. Different words share one only by chance: of two words of n bytes, with about 2^-64, or (n / 2^31)^2 where they were made to collide modulo 2^64."""
        out, b = self.hash, self.bytes.astype(np.int64) + 1
        for prime, base in _PRIMES:
            power, inverse = _prime_powers(prime, base, max(SLICE, len(b)) + 1)
            total = np.zeros(len(b) + 1, np.int64)
            np.cumsum(b * power[: len(b)] % prime, out=total[1:])
            value = (total[self.end] - total[self.start]) % prime * inverse[self.start] % prime
            out = mix(out * U(_P) + value.astype(U), 7)
        return out

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end."""
        return mix((self._sum[end] - self._sum[start]) * self._inv[start] + (end - start).astype(U))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of slices of an Arrow column of texts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        to = min(to, n)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to
