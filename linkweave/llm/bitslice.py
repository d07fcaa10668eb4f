"""Bit-sliced Hamming comparison inside blocks of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: (query, word of 64 lanes) cells compared at once; bounds the memory of one step.
CELLS = 1 << 13


def planes_of(fps: np.ndarray) -> np.ndarray:
    """fps [n, W] of uint64, n a multiple of 64 -> planes [64 W, n / 64]: bit l of planes[b, w] is bit b of row 64 w + l."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a, b, c):
    """Carry-save adder: the sum bit and the carry bit of three bit vectors."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count exceeds radius."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], ALL)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same &= count[k]
        else:
            more |= same & count[k]
            same &= ~count[k]
    return more


def near(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int) -> tuple:
    """For cells (query row, word of 64 rows, mask of the lanes that matter): the cells that keep a lane within radius, and
    those lanes as a bit mask.

    Eight planes at a time go through carry-save adders into vertical counters, so 64 distances grow per operation. Every
    32 planes, cells whose lanes have all passed the radius are abandoned.
    """
    depth = max(4, int(radius).bit_length() + 1, planes.shape[0].bit_length())
    count = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    for b0 in range(0, planes.shape[0], 8):
        d = []
        for b in range(b0, b0 + 8):
            bit = (fps[query, b >> 6] >> np.uint64(b & 63)) & np.uint64(1)
            d.append(planes[b, word] ^ (np.uint64(0) - bit))
        one, t1 = _add(count[0], d[0], d[1])
        one, t2 = _add(one, d[2], d[3])
        one, t3 = _add(one, d[4], d[5])
        one, t4 = _add(one, d[6], d[7])
        two, f1 = _add(count[1], t1, t2)
        two, f2 = _add(two, t3, t4)
        four, carry = _add(count[2], f1, f2)
        count[:3] = one, two, four
        for k in range(3, depth):
            count[k], carry = count[k] ^ carry, count[k] & carry
        if b0 % 32 == 24 or b0 + 8 == planes.shape[0]:
            alive = ~_over(count, radius) & lanes
            keep = alive != 0
            if b0 + 8 == planes.shape[0]:
                return query[keep], word[keep], alive[keep]
            if keep.sum() < 0.7 * len(keep):
                query, word, lanes = query[keep], word[keep], lanes[keep]
                count = [c[keep] for c in count]
    return query, word, lanes


def _lanes(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Masks of the lanes lo <= l < hi of a word, 0 <= lo <= 64 and hi > 0 beyond 64 counting as 64."""
    lo, hi = lo.astype(np.uint64), np.minimum(hi, 64).astype(np.uint64)
    up = np.where(hi >= 64, ALL, (np.uint64(1) << (hi & np.uint64(63))) - np.uint64(1))
    down = np.where(lo >= 64, ALL, (np.uint64(1) << (lo & np.uint64(63))) - np.uint64(1))
    return up & ~down


def pairs(starts: np.ndarray, sizes: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (a < b) of the same run within radius; runs are consecutive rows of fps, given by starts and sizes.

    Runs lie one behind the other in the planes, so a word of 64 lanes may hold many short runs; a mask keeps a query to
    the rest of its own run. Memory is in proportion to the rows, however short the runs.
    """
    n = int(sizes.sum())
    if not n:
        return
    local = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = np.repeat(starts, sizes) + local
    end = np.repeat(np.cumsum(sizes), sizes)  # where the run of each slot ends
    packed = np.zeros(((n + 63) // 64 * 64, fps.shape[1]), np.uint64)
    packed[:n] = fps[rows]
    planes = np.concatenate([planes_of(packed[lo : lo + 8192]) for lo in range(0, len(packed), 8192)], axis=1)
    slot = np.nonzero(np.arange(n) + 1 < end)[0]  # the last row of a run has no partner behind it
    first = (slot + 1) // 64
    words = (end[slot] - 1) // 64 - first + 1
    ends = np.cumsum(words)
    lo = 0
    while lo < len(slot):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, "right")))
        w = words[lo:hi]
        query = np.repeat(slot[lo:hi], w)
        word = np.repeat(first[lo:hi], w) + np.arange(len(query)) - np.repeat(np.cumsum(w) - w, w)
        lanes = _lanes(np.maximum(query + 1 - 64 * word, 0), end[query] - 64 * word)
        q, w, alive = near(planes, packed, query, word, lanes, radius)
        if len(q):
            bits = np.unpackbits(np.ascontiguousarray(alive)[:, None].view(np.uint8), axis=1, bitorder="little")
            cell, lane = np.nonzero(bits)
            yield rows[q[cell]], rows[w[cell] * 64 + lane]
        lo = hi


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the pairs (a, b) in label, in place; a class is named by its least row."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(label, np.maximum(x, y), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def runs_of(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole runs of equal key from sorted batches, of so many rows or bytes at least; a run is never cut."""
    held: list[pa.RecordBatch] = []
    n = held_bytes = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        held_bytes += batch.get_total_buffer_size()
        if n >= rows or held_bytes >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            last = [t[k][-1].as_py() for k in key]
            same = np.ones(t.num_rows, bool)
            for k, v in zip(key, last, strict=True):
                same &= t[k].to_numpy() == v
            cut = int(np.argmin(same[::-1])) if not same.all() else t.num_rows
            if cut < t.num_rows:
                yield t.slice(0, t.num_rows - cut)
                held = t.slice(t.num_rows - cut).take(pa.array(range(cut))).to_batches()  # a copy: a slice keeps all buffers
                n, held_bytes = cut, sum(b.get_total_buffer_size() for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_bounds(t: pa.Table, key: list[str]) -> tuple[np.ndarray, np.ndarray]:
    new = np.zeros(t.num_rows, bool)
    new[0] = True
    for k in key:
        v = t[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.nonzero(new)[0]
    return starts, np.diff(np.append(starts, t.num_rows))
