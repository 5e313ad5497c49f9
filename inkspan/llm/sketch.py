"""Word shingles and MinHash sketches of single texts; small helpers that run inside Spark tasks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
N_BAND = 64  # hashes for banding
N_CHECK = 64  # further hashes, independent of the bands, for verification


def _constants(n: int, seed: int, bits: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << bits, size=n, dtype=np.uint64) | np.uint64(1)


_MULTIPLY = _constants(N_BAND + N_CHECK, 11, 32).astype(np.uint32)[:, None]
_ADD = _constants(N_BAND + N_CHECK, 12, 32).astype(np.uint32)[:, None]
_PLACE = _constants(64, 13, 64)


def tune_bands(threshold: float, recall: float = 0.9995, hashes: int = N_BAND) -> tuple[int, int]:
    """(bands, rows): the longest rows whose bands still find a pair at ``threshold`` with this probability."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            best = (bands, rows)
    return best


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_BYTE = _constants(256, 14, 64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_known_powers: dict[int, np.ndarray] = {}
CHUNK = 1 << 18  # bytes of text hashed at once


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    found = _known_powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, CHUNK), base, np.uint64)
        found[0] = 1
        found = np.cumprod(found)
        if n <= CHUNK:
            _known_powers[base] = found
    return found[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and the place where each text's words begin.

    Words are A-Z lower-cased runs outside space and U+0009..U+000D. A word's hash is its polynomial over the bytes,
    taken as a difference of prefix sums, so a whole chunk of texts is hashed in a few array steps.
    """
    raw = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts], b""]), np.uint8)
    blank = _SPACE[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    h, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # words of CHUNK bytes at a time, so a long text needs no more memory than its words
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + CHUNK, "right")))
        n = int(ends[j - 1] - lo)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[lo : lo + n]] * powers(_BASE, n), out=sums[1:])
        h[i:j] = (sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * powers(_INVERSE, n)[starts[i:j] - lo]
        i = j
    mix(h)
    begin = np.cumsum([1, *[len(t or b"") + 1 for t in texts]])
    return h, np.searchsorted(starts, begin)


def chunks(texts: list[bytes | None]) -> Iterator[slice]:
    """Slices of about CHUNK bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= CHUNK:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def _shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of fewer words, the whole sequence as one."""
    n = len(h)
    if not n:
        return h
    if n < k:
        s = (h * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)
    else:
        s = h[: n - k + 1] * _PLACE[0]
        for i in range(1, k):
            s += h[i : n - k + 1 + i] * _PLACE[i]
    return mix(s)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of one text."""
    return np.unique(_shingles(word_hashes([text])[0], k))


def minhash(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """N_BAND + N_CHECK minima of 32-bit hash functions over each set; the sets follow each other and begin at ``starts``."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.empty((len(starts), N_BAND + N_CHECK), np.uint32)
    for j in range(N_BAND + N_CHECK):
        v = x * _MULTIPLY[j]
        v += _ADD[j]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        low[:, j] = np.minimum.reduceat(v, starts)
    return low


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per signature (row) and band."""
    v = signatures[:, : bands * rows].astype(np.uint64).reshape(-1, bands, rows)
    key = (v * _PLACE[8 : 8 + rows]).sum(axis=2)
    key ^= key >> np.uint64(31)
    return (key * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased runs outside space and U+0009..U+000D."""
    return text.lower().split() if text else []


def sketcher(k: int, bands: int, rows: int, min_words: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow function: (vertex, text) -> SKETCH_SCHEMA; digests and sketches are null for texts without words; texts
    of fewer than ``min_words`` words give no row. sig holds the low 16 bits of the verification hashes, bands the band keys."""

    def part(ids: pa.Array, texts: list[bytes | None]) -> pa.RecordBatch:
        h, begin = word_hashes(texts)
        n_words = np.diff(begin)
        at = np.flatnonzero(n_words >= min_words)
        digests = np.zeros((len(at), 2), np.int64)
        sizes, sets, worded = np.zeros(len(at), np.int64), [], np.flatnonzero(n_words[at] > 0)
        for row in worded.tolist():
            i = at[row]
            digests[row] = np.frombuffer(hashlib.blake2b(b" ".join(words_of(texts[i])), digest_size=16).digest(), ">i8")
            sets.append(np.unique(_shingles(h[begin[i] : begin[i + 1]], k)))
            sizes[row] = len(sets[-1])
        none = np.ones(len(at), bool)
        none[worded] = False
        sig: list = [None] * len(at)
        keys: list = [None] * len(at)
        if sets:
            found = minhash(np.concatenate(sets), np.cumsum([0, *[len(x) for x in sets[:-1]]]))
            for row, check, bk in zip(worded.tolist(), found[:, N_BAND:].astype(np.uint16), band_keys(found, bands, rows), strict=True):
                sig[row], keys[row] = check.tobytes(), bk
        columns = [pa.array(digests[:, 0], mask=none), pa.array(digests[:, 1], mask=none), pa.array(sizes), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *columns], ["vertex", "d1", "d2", "n", "sig", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for some in chunks(texts):
                yield part(batch.column(0).slice(some.start, some.stop - some.start), texts[some])

    return run


SKETCH_SCHEMA = "vertex {kind}, d1 long, d2 long, n long, sig binary, bands array<long>"


def least_matches(threshold: float, miss: float, batch: int = 16, total: int = N_CHECK) -> list[tuple[int, int]]:
    """(compared, least matches) after each batch of hashes: fewer matches leave a posterior probability below
    ``miss`` that the similarity reaches ``threshold``, starting from a uniform prior."""

    def tail(m: int, n: int) -> float:  # P(similarity >= threshold | m of n match) under Beta(m + 1, n - m + 1)
        return sum(math.comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [(n, next(m for m in range(n + 1) if m == n or tail(m, n) >= miss)) for n in range(batch, total + 1, batch)]


def survivors(a: np.ndarray, b: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Row numbers that are never pruned; a and b: (rows, N_CHECK) or one of them (N_CHECK,), compared batch by batch."""
    rows = np.arange(max(len(a) if a.ndim == 2 else 0, len(b) if b.ndim == 2 else 0))
    got = np.zeros(len(rows), np.int32)
    at = 0
    for n, least in steps:
        x = a[rows, at:n] if a.ndim == 2 else a[at:n]
        y = b[rows, at:n] if b.ndim == 2 else b[at:n]
        got = got + (x == y).sum(axis=1)
        keep = got >= least
        rows, got, at = rows[keep], got[keep], n
        if not len(rows):
            break
    return rows
