"""Word and window hashes of whole Arrow text columns by numpy, with no loop over words.

Words are maximal runs of bytes other than ASCII white space. Hashes do not depend on where a word
stands, so texts are worked on in chunks of about a megabyte whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a chunk, and words hashed into windows at once.
CHUNK, RUN = 1 << 20, 1 << 16

_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_MIXES = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xD6E8FEB86659FD93))
#: The bits that a lane of 0 to 8 bytes keeps.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(x: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIXES[which]
    x = (x ^ (x >> np.uint64(29))) * _MIXES[1 - which]
    return x ^ (x >> np.uint64(32))


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, the rows' offsets in them) of runs of rows; null is empty."""
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
        part = data[offsets[at] : offsets[stop]]
        yield at, stop, _LOWER[part] if lower else part, offsets[at : stop + 1] - offsets[at]
        at = stop


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; a word ends with its row."""
    gap = _GAP[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = edge[:-1].copy()
    first[1:] |= gap[:-1]
    last = edge[1:].copy()
    last[:-1] |= gap[1:]
    starts = np.flatnonzero(first & ~gap)
    return starts, np.flatnonzero(last & ~gap) + 1, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every word: its lanes of eight bytes are mixed with their numbers, summed, and mixed with the length."""
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    at_byte = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    sizes, base = ends - starts, _BASES[which]
    out = mix((at_byte[starts] & _KEPT[np.minimum(sizes, 8)]) + base, which)
    long = np.flatnonzero(sizes > 8)
    lanes, at = (sizes[long] - 1) // 8, 0  # lanes after the first
    total = np.cumsum(lanes)
    while at < len(long):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, side="right")))
        n, word = lanes[at:stop], long[at:stop]
        first = np.cumsum(n) - n
        lane = np.arange(n.sum()) - np.repeat(first, n) + 1
        place, left = np.repeat(starts[word], n) + 8 * lane, np.repeat(sizes[word], n) - 8 * lane
        mixed = mix((at_byte[place] & _KEPT[np.minimum(left, 8)]) + base * (lane + 1).astype(np.uint64), which)
        out[word] += np.add.reduceat(mixed, first)
        at = stop
    return mix(out + sizes.astype(np.uint64) * _BASES[1 - which], which)


def window_hashes(hashes: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` consecutive word hashes: runs of doubling length are mixed into pairs."""
    total = max(0, len(hashes) - size + 1)
    out = np.empty(total, dtype=np.uint64)
    for at in range(0, total, RUN):
        n = min(RUN, total - at)
        part, bit, run, have, made = hashes[at : at + n + size - 1], 1, 1, 0, None
        while True:
            if size & bit:  # what is made so far, then a run of ``bit`` words
                made = part[:n] if made is None else mix(made * _BASES[which] + part[have : have + n], which)
                have += bit
            bit *= 2
            if bit > size:
                break
            part = mix(part[:-run] * _BASES[1 - which] + part[run:], which)
            run *= 2
        out[at : at + n] = mix(made + np.uint64(size), 1 - which)
    return out


def rolling(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) over every run of ``size`` values, by doubling."""
    if len(x) < size:
        return x[:0]
    have, got = 1, x
    while 2 * have <= size:
        got, have = best(got[:-have], got[have:]), 2 * have
    return best(got[: len(got) - (size - have)], got[size - have :]) if have < size else got
