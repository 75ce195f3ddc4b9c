"""Words, word shingles as 64-bit hashes, and the two signatures over shingle sets.

``min_codes`` is b-bit minwise hashing, ``icws_codes`` is improved consistent weighted sampling. Both give, per document,
one code per random permutation; equal codes of two documents have the probability of their (weighted) Jaccard similarity.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)
_M3, _M4 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
#: Elements that one round of array operations takes: few enough to stay in the processor's cache.
PIECE = 256
_word_hash: dict[str, int] = {}
_WORD_CACHE = 500_000


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits of the lower-cased text; none for None."""
    return _WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str]) -> np.ndarray:
    if len(_word_hash) > _WORD_CACHE:
        _word_hash.clear()
    try:
        return np.fromiter(map(_word_hash.__getitem__, ws), np.uint64, len(ws))
    except KeyError:
        for w in ws:
            if w not in _word_hash:
                _word_hash[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(_word_hash.__getitem__, ws), np.uint64, len(ws))


def shingles(ws: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of the k-word sequences, how often each occurs)."""
    if len(ws) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = word_hashes(ws)
    n = len(h) - k + 1
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = mix(acc * _P + h[j : j + n] + np.uint64(j))
    return np.unique(acc, return_counts=True)


def _seeds(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _P)


def _folded(h: np.ndarray) -> np.ndarray:
    """32 bits of each hash, for arithmetic in narrow lanes."""
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


class MinHash:
    """b-bit minwise fingerprints: ``n`` components of 16 bits, joined to blocks of ``rows``; the lowest bits form the n-bit code compared by Hamming distance."""

    def __init__(self, blocks: int, rows: int, seed: int = 1):
        self.blocks, self.rows, self.n = blocks, rows, blocks * rows
        self.mul = _folded(_seeds(self.n, seed))[:, None] | np.uint32(1)
        self.add = _folded(_seeds(self.n, seed + 1))[:, None]

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(one 64-bit key per block, the code of n bits as n / 64 words)."""
        least = np.full(self.n, 0xFFFFFFFF, np.uint32)
        x = _folded(h)
        for i in range(0, len(x), PIECE):
            y = x[i : i + PIECE] * self.mul
            y += self.add
            y ^= y >> np.uint32(15)
            y *= _M3
            np.minimum(least, y.min(axis=1), out=least)
        code = mix(least.astype(np.uint64)) & np.uint64(0xFFFF)
        return block_keys(code, self.rows), np.packbits(np.resize((code & np.uint64(1)).astype(np.uint8), -(-self.n // 64) * 64)).view(np.uint64)


def block_keys(codes: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` codes; the block's number is part of the key."""
    c = codes.reshape(-1, rows)
    acc = np.arange(1, len(c) + 1, dtype=np.uint64) * _P
    for j in range(rows):
        acc = mix(acc * _P + c[:, j])
    return acc


def _gamma2_table(bits: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) law at the mid-points of 2**bits equal steps, by bisection of 1 - (1 + x) exp(-x)."""
    q = (np.arange(1 << bits) + 0.5) / (1 << bits)
    lo, hi = np.zeros_like(q), np.full_like(q, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < q
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


class ICWS:
    """Improved consistent weighted sampling: ``blocks * rows`` samples of a weighted set.

    Two sets agree in a sample with the probability of their weighted Jaccard similarity (Ioffe 2010). r and c are drawn
    from Gamma(2, 1) and beta from U(0, 1), all as functions of (element, sample number) only.
    """

    def __init__(self, blocks: int, rows: int, seed: int = 7):
        self.blocks, self.rows, self.n = blocks, rows, blocks * rows
        self.mul = _folded(_seeds(self.n, seed))[:, None] | np.uint32(1)
        g = _gamma2_table(10)
        self.r, self.lnc = g.astype(np.float32), np.log(g).astype(np.float32)

    def _draws(self, x: np.ndarray, lns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ln a, t), samples by elements; the element with the least a is the sample. Of 32 bits r and c take ten each, beta twelve."""
        x = x * self.mul
        x ^= x >> np.uint32(15)
        x *= _M3
        x ^= x >> np.uint32(13)
        x *= _M4
        x ^= x >> np.uint32(16)
        r, lnc = self.r.take(x >> np.uint32(22)), self.lnc.take((x >> np.uint32(12)) & np.uint32(0x3FF))
        beta = (x & np.uint32(0xFFF)).astype(np.float32)
        beta += np.float32(0.5)
        beta *= np.float32(2**-12)
        t = lns / r
        t += beta
        np.floor(t, out=t)
        beta -= np.float32(1)
        np.subtract(t, beta, out=beta)
        beta *= r
        lnc -= beta
        return lnc, t

    def __call__(self, h: np.ndarray, weight: np.ndarray) -> np.ndarray:
        lns, x, rows = np.log(weight).astype(np.float32), _folded(h), np.arange(self.n)
        best = None
        for i in range(0, len(h), PIECE):
            a, t = self._draws(x[i : i + PIECE], lns[i : i + PIECE])
            k = a.argmin(axis=1)
            found, code = a[rows, k], mix(h[i : i + PIECE][k] + t[rows, k].astype(np.int64).astype(np.uint64) * _P)
            best, codes = (found, code) if best is None else (np.minimum(best, found), np.where(found < best, code, codes))
        return block_keys(codes, self.rows)
