"""Word spans and 64-bit word hashes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Longest word hashed in blocks (the others go through a library's hash), and words hashed at a time.
LONG, SLICE = 512, 1 << 16
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


#: Odd factor and step of the word hashes, and masks that keep the first 0 to 8 bytes of a block.
BASE, STEP = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def blocks(data: np.ndarray) -> np.ndarray:
    """A view with the eight bytes from each place on as one number (zeros beyond the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def spans(data: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word; ``cut`` marks bytes that begin a new word after another one."""
    word = ~IS_SPACE[data]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    begin = word & ~before
    end = before & ~word
    if cut is not None:
        cut = cut & word & before
        begin |= cut
        end |= cut
    ends = np.flatnonzero(end)
    if len(word) and word[-1]:
        ends = np.append(ends, len(word))
    return np.flatnonzero(begin), ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span, mixed after every block of eight bytes.

    No two spans of up to eight bytes and the same length share a hash; others do
    by chance only (2^-64 a pair).  Callers that need certainty compare the bytes."""
    view, out = blocks(data), np.empty(len(starts), U)
    for i in range(0, len(starts), SLICE):
        out[i:i + SLICE] = _hash_slice(data, view, starts[i:i + SLICE], ends[i:i + SLICE], seed)
    return out


def _hash_slice(data: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    sizes = ends - starts
    out = mix(sizes.astype(U) * U(STEP) + U(seed & 0xFFFFFFFFFFFFFFFF))
    for i in np.flatnonzero(sizes > LONG):
        key = seed.to_bytes(8, "little")
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8, key=key).digest(), "little")
    live, at = np.flatnonzero(sizes <= LONG), 0
    while len(live):
        left = sizes[live] - at
        block = view[starts[live] + at]
        block &= KEEP[np.minimum(left, 8)]
        block *= U(BASE)
        out[live] = mix((out[live] + U(STEP)) ^ block)
        at += 8
        live = live[left > 8]
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Whether each span of ``data`` holds the same bytes as its span of ``other``."""
    view, seen = blocks(data), blocks(other)
    out = ends - starts == stops - begins
    for i in range(0, len(starts), SLICE):
        own, its = starts[i:i + SLICE], begins[i:i + SLICE]
        sizes, live, at = ends[i:i + SLICE] - own, np.flatnonzero(out[i:i + SLICE]), 0
        while len(live):
            left = sizes[live] - at
            differ = ((view[own[live] + at] ^ seen[its[live] + at]) & KEEP[np.minimum(left, 8)]) != 0
            out[i + live[differ]] = False
            live = live[~differ & (left > 8)]
            at += 8
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a space after each, and where each begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=begins[1:])
    return np.frombuffer(b"".join(x for t in texts for x in (t, b" ")), np.uint8), begins


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the index of each text's first word (and the end)."""
    if lower:
        texts = [t.translate(UPPER) for t in texts]
    data, begins = joined(texts)
    starts, ends = spans(data)
    return hash_spans(data, starts, ends), np.searchsorted(starts, begins)


def grams(words: np.ndarray, offsets: np.ndarray, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``n`` successive words, and each text's first index (and the end).

    ``whole_short``: a text of fewer, but at least one, words gives its whole
    sequence as one gram; otherwise it gives none."""
    sizes = np.diff(offsets)
    h = np.zeros(max(0, len(words) - n + 1), U)
    for k in range(n):
        h = mix(h * U(BASE) + words[k:k + len(h)] + U(k + 1))
    count = np.maximum(sizes - n + 1, 0)
    first = np.zeros(len(count) + 1, np.int64)
    keep = np.ones(len(h), bool)
    for k in range(1, n):  # windows that would cross a text's end
        at = offsets[1:][sizes >= k] - k
        keep[at[at < len(h)]] = False
    keep_h = h[keep]
    if not whole_short:
        np.cumsum(count, out=first[1:])
        return keep_h, first
    short = (sizes > 0) & (sizes < n)
    count = count + short
    np.cumsum(count, out=first[1:])
    out = np.empty(first[-1], U)
    full = np.repeat(~short, count)
    out[full] = keep_h
    for d in np.flatnonzero(short):
        g = U(0)
        with np.errstate(over="ignore"):
            for k, w in enumerate(words[offsets[d]:offsets[d + 1]]):
                g = mix(np.asarray([g * U(BASE) + w + U(k + 1)], U))[0]
            out[first[d]] = mix(np.asarray([g ^ U(sizes[d])], U))[0]
    return out, first


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on beside the executor's heap."""
    import ctypes
    import sys

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, NULL as empty."""
    import pyarrow as pa

    binary = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [t or b"" for t in binary.to_pylist()]
