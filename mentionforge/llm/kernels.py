"""numpy kernels over the bytes of many texts at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Words and lines up to this many bytes are hashed in lanes of 8 bytes, longer ones by a digest each.
LANES = 64
#: Places of a text that are fingerprinted at a time.
PLACES = 1 << 14
_SEEDS = (0x243F6A8885A308D3, 0xA4093822299F31D0)
_STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: Space and the controls from tab to carriage return; no byte of a longer UTF-8 sequence is among them.
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a big-endian number, so that numbers order as bytes do; zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    out = np.empty(len(data) + 1, U64)
    for r in range(min(8, len(out))):
        part = padded[r:]
        own = out[r::8]
        own[:] = part[: 8 * len(own)].view(">u8") if len(part) >= 8 * len(own) else np.append(part, np.zeros(8, np.uint8))[: 8 * len(own)].view(">u8")
    return out


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, half: int = 0) -> np.ndarray:
    """Fingerprints of data[start:end]: one of two 64-bit halves that are independent of each other.

    Lane after lane goes through a bijection that is not linear, so strings built of few letters are no special case;
    spans over 8 * LANES bytes go through a keyed digest.
    """
    size = ends - starts
    step, seed = U64(_STEPS[half]), U64(_SEEDS[half])
    h = mix(size.astype(U64) * step + seed)
    lane = lanes(data)
    live = np.flatnonzero((size > 0) & (size <= 8 * LANES))
    at, left = starts[live], size[live]
    while len(live):
        x = lane[at]
        short = left < 8
        if short.any():
            x[short] &= ~U64(0) << (U64(64) - U64(8) * left[short].astype(U64))
        h[live] = mix(h[live] * step + x)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > 8 * LANES).tolist():
        raw = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16, key=b"spans").digest()
        h[k] = np.frombuffer(raw, "<u8")[half]
    return h


def _joined(left: np.ndarray, right: np.ndarray, half: int) -> np.ndarray:
    out = left * U64(_STEPS[half])
    out ^= out >> U64(32)
    out += right
    out *= U64(0xFF51AFD7ED558CCD)
    out ^= out >> U64(29)
    return out


def windows(lane: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of the `width` (8 or more) bytes from each start: a chain over lanes, the last may overlap."""
    out = mix(lane[at] + U64(_SEEDS[0]))
    for k in range(8, width, 8):
        out = _joined(out, lane[at + min(k, width - 8)], 0)
    return mix(out)


def every_window(lane: np.ndarray, width: int, half: int) -> np.ndarray:
    """One half of the fingerprints of the `width` (8 or more) bytes from each place on: doubled until two cover them.

    Worked off in blocks of places that stay in the processor's cache.
    """
    shifts, size = [], 8
    while 2 * size <= width:
        shifts.append(size)
        size *= 2
    if width > size:
        shifts.append(width - size)
    step, more = U64(_STEPS[half]), width - 8
    n = max(len(lane) - 1 - more, 0)
    out = np.empty(n, U64)
    one, two, odd = np.empty((3, min(n, PLACES) + more), U64)
    for lo in range(0, n, PLACES):
        hi = min(lo + PLACES, n)
        k = hi - lo + more
        cur = one[:k]
        np.multiply(lane[lo : lo + k], step, out=cur)
        cur ^= np.right_shift(cur, U64(29), out=odd[:k])
        for i, shift in enumerate(shifts):
            k -= shift
            nxt, x = (one if i % 2 else two)[:k], odd[:k]
            np.multiply(cur[:k], step, out=nxt)
            nxt ^= np.right_shift(nxt, U64(32), out=x)
            nxt += cur[shift : shift + k]
            nxt *= U64(0xFF51AFD7ED558CCD)
            nxt ^= np.right_shift(nxt, U64(29), out=x)
            cur = nxt
        out[lo:hi] = mix(cur)
    return out


def ordered(hi: np.ndarray, lo: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order of fingerprints (second halves or none) and where in it the distinct ones start; equal ones stay in turn.

    Sorted are numbers of a fingerprint's first bits and its place; where first bits agree, whole ones decide.
    """
    n = len(hi)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = U64(max(n - 1, 1).bit_length())
    low = (U64(1) << bits) - U64(1)
    key = hi & ~low
    key |= np.arange(n, dtype=U64)
    key.sort()
    order = (key & low).view(np.int64)
    key >>= bits
    near = key[1:] == key[:-1]
    fresh = np.ones(n, bool)
    fresh[1:] = ~near
    at = np.flatnonzero(near)
    same = _alike(hi, lo, order, at)
    if not same.all():
        # all of a run of equal first bits, if its fingerprints differ
        run = np.cumsum(fresh)
        mixed = np.zeros(run[-1] + 1, bool)
        mixed[run[at[~same]]] = True
        part = np.flatnonzero(mixed[run])
        own = order[part]
        order[part] = own[np.lexsort((own, hi[own]) if lo is None else (own, lo[own], hi[own]))]
        same = _alike(hi, lo, order, at)
    fresh[at[~same] + 1] = True
    return order, np.flatnonzero(fresh)


def _alike(hi: np.ndarray, lo: np.ndarray | None, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the fingerprints at places `at` and at + 1 of an order are the same."""
    a, b = order[at], order[at + 1]
    same = hi[a] == hi[b]
    if lo is not None:
        same &= lo[a] == lo[b]
    return same


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or wide:
        _, offs, data = column.buffers()
        kind = np.int64 if wide else np.int32
        offs = np.frombuffer(offs, kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        return data[offs[0] : offs[-1]], offs - offs[0]
    return text_buffers(column.cast(pa.large_binary()))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches of about `most` bytes of text (one text at least), with their bytes and offsets."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi


def words(data: np.ndarray, offs: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document of all words: maximal runs of bytes that are not blank, within a document."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~blank[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[offs[:-1]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    cut = offs[1:] - 1
    after[cut[cut >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, doc


def shingles(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's distinct word shingles as 128-bit fingerprints (two halves), sorted, end to end, and offsets.

    A-Z count as a-z. A document of fewer words than `width` has its whole sequence as its one shingle; one without
    words has none.
    """
    n = len(offs) - 1
    starts, ends, doc = words(data, offs)
    if not len(starts):
        return np.empty(0, U64), np.empty(0, U64), np.zeros(n + 1, np.int64)
    low = LOWER[data]
    per = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(per)])
    m = max(len(starts) - width + 1, 0)
    ok = doc[:m] == doc[width - 1 :] if m else np.empty(0, bool)
    count = np.maximum(per - width + 1, 0)
    whole = np.flatnonzero((per > 0) & (per < width))
    count[whole] = 1
    at = np.concatenate([[0], np.cumsum(count)])
    put = np.ones(at[-1], bool)
    put[at[whole]] = False
    halves = []
    for half in range(2):
        wh = spans(low, starts, ends, half)
        h = np.full(m, U64(width))
        for k in range(width if m else 0):
            h = mix(h * U64(_STEPS[half]) + wh[k : k + m])
        out = np.empty(at[-1], U64)
        out[put] = h[ok]
        for d in whole:
            x = np.full(1, U64(per[d]))
            for k in range(first[d], first[d + 1]):
                x = mix(x * U64(_STEPS[half]) + wh[k : k + 1])
            out[at[d]] = x[0]
        halves.append(out)
    hi, lo = halves
    for d in np.flatnonzero(count > 1):
        part = slice(at[d], at[d + 1])
        order = np.argsort(hi[part])
        hi[part], lo[part] = hi[part][order], lo[part][order]
        if (hi[part][1:] == hi[part][:-1]).any():
            order = np.lexsort((lo[part], hi[part]))
            hi[part], lo[part] = hi[part][order], lo[part][order]
    fresh = np.ones(len(hi), bool)
    fresh[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    fresh[at[:-1][count > 0]] = True
    return hi[fresh], lo[fresh], np.concatenate([[0], np.cumsum(fresh)])[at]


def min_hashes(values: np.ndarray, offs: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """(documents, n) of 16-bit minimum hashes over each document's values; 0 where it has none."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, n, dtype=np.uint32)
    x = (values >> U64(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(offs))
    out = np.zeros((len(offs) - 1, n), np.uint16)
    if len(full):
        at = offs[:-1][full]
        for k in range(n):
            y = x * a[k]
            y += b[k]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[full, k] = (np.minimum.reduceat(y, at) * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)
    return out


def binary_column(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def binary_slices(raw: np.ndarray, offs: np.ndarray) -> pa.Array:
    """A binary column of the parts of `raw` (under 2 GB) between offsets that start with 0."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw)])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
