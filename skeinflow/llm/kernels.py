"""Array kernels over the UTF-8 buffers of Arrow string columns: words, their hashes, hashes of word windows.

Everything is done on bytes, a few MB at a time, without a Python object for each word. The separators of all word
definitions used here are ASCII, so that bytes of longer UTF-8 sequences never need to be decoded.
"""

from __future__ import annotations

import ctypes
import hashlib
import secrets
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers: of the steps from eight bytes to the next, of the polynomial hashes of word windows (two).
LANE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Steps of eight bytes that a word is hashed by; longer ones go through BLAKE2.
LANES = 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
#: Bytes of text that a kernel works on at once. A longer single text is worked on alone.
CHUNK = 1 << 20

#: Words [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = True
#: A-Z to a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k below n, at least."""
    up, down = _POWERS.get(base, (np.ones(1, U), np.ones(1, U)))
    if len(up) < n:
        n += n // 4
        up, down = np.full(n, base, U), np.full(n, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _POWERS[base] = up, down
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (that of splitmix64), in place where it can."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes.

    Up to eight bytes it is one-to-one among spans of one length; up to 64 each step mixes eight more into what is there;
    longer ones are hashed by BLAKE2, so no algebra of a polynomial makes two of them equal.
    """
    size = stop - start
    out = mix(size.astype(U) * U(0x632BE59BD9B4E019) + U(1))
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    live = np.arange(len(start))
    for k in range(LANES):
        live = live[size[live] > 8 * k]
        if not len(live):
            break
        lane = lanes[start[live] + 8 * k] & _MASKS[np.minimum(size[live] - 8 * k, 8)]
        out[live] = mix(out[live] * U(LANE) ^ lane)
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_key() -> bytes:
    """A secret for one run of an operator: whoever writes the texts can't know which words would collide under it."""
    return secrets.token_bytes(16)


@lru_cache(16)
def _factors(key: bytes) -> np.ndarray:
    """Factors of four multilinear hashes: for each a constant, one for the length and two for every eight bytes."""
    n = 4 * (2 + 2 * LANES)
    stream = b"".join(hashlib.blake2b(i.to_bytes(8, "little"), key=key).digest() for i in range(-(-n // 8)))
    return np.frombuffer(stream, "<u8")[:n].reshape(4, -1).copy()


def keyed_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, key: bytes, halves: int = 1) -> list[np.ndarray]:
    """One or two 64-bit hashes of each span of bytes, under a secret key.

    Each half is two multilinear hashes of 32 bits: any two given spans of up to 64 bytes are equal in one with a chance
    of 2**-32 over the keys, in a half with 2**-64, in both with 2**-128, whatever the spans are. Longer spans go
    through BLAKE2 with the key.
    """
    size, factors = (stop - start), _factors(key)[: 2 * halves]
    sums = [f[0] + f[1] * size.astype(U) for f in factors]
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))
    live, low = None, U(0xFFFFFFFF)
    for k in range(LANES):
        live = np.flatnonzero(size > 8 * k) if live is None else live[size[live] > 8 * k]
        if not len(live):
            break
        lane = lanes[start[live] + 8 * k] & _MASKS[np.minimum(size[live] - 8 * k, 8)]
        for s, f in zip(sums, factors, strict=True):
            s[live] += f[2 + 2 * k] * (lane & low) + f[3 + 2 * k] * (lane >> U(32))
    out = [(sums[2 * h] & ~low) | (sums[2 * h + 1] >> U(32)) for h in range(halves)]
    for i in np.flatnonzero(size > 8 * LANES).tolist():
        digest = hashlib.blake2b(data[start[i] : stop[i]].tobytes(), key=key, digest_size=16).digest()
        for h in range(halves):
            out[h][i] = int.from_bytes(digest[8 * h : 8 * h + 8], "little")
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def trim() -> None:
    """Give freed memory back: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most so many bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


class Words:
    """Words of the texts of a piece: byte bounds, 64-bit hashes; ptr[i]:ptr[i + 1] are the words of text i.

    With a key, the hashes are keyed_hashes(), and hash_2 is the second half if two are asked for.
    """

    def __init__(self, column: pa.Array, table: np.ndarray = SPACED, lower: bool = False, hashed: bool = True, key: bytes | None = None, halves: int = 1):
        self.data, self.off = utf8(column)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = table[self.data]
        full = self.off[:-1][self.off[:-1] < self.off[1:]]  # where a text begins; empty ones begin nothing
        before = np.empty(n, bool)
        before[:1], before[1:] = False, inside[:-1]
        before[full] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1:], after[:-1] = False, inside[1:]
        after[full[1:] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.ptr = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.ptr)
        if hashed and key:
            self.hash, *rest = keyed_hashes(self.data, self.start, self.end, key, halves)
            self.hash_2 = rest[0] if rest else None
        elif hashed:
            self.hash = span_hashes(self.data, self.start, self.end)

    def text_of(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(h: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """A hash of each k consecutive values of h; h may hold several texts, and windows over a bound mean nothing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    up, down = powers(base, len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def sliding(a: np.ndarray, w: int, f: Callable) -> np.ndarray:
    """f (np.minimum or np.maximum) over each w consecutive values, by doubling."""
    if len(a) < w:
        return a[:0]
    have = 1
    out = a
    while have * 2 <= w:
        out = f(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = f(out[: len(out) - (w - have)], out[w - have :])
    return out


def starts_of(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k lie within one text."""
    ok = np.zeros(max(0, n - k + 1), np.int8)
    if len(ok):
        ok[:] = 1
        for back in range(1, k):
            at = ptr[1:-1] - back
            ok[at[(at >= 0) & (at < len(ok))]] = 0
    return ok.astype(bool)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The integers of all ranges start[i] ... start[i] + count[i] - 1, one after another."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return first + np.arange(total)
