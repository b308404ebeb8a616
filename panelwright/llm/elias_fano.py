"""Elias-Fano sequences and packed files, read through memory maps with vectorised access."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

import numpy as np
from pyarrow import fs

U1, U64 = np.uint64(1), np.uint64(64)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of every value, one after the other, as 64-bit words and one to spare."""
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    if width:
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        v = values & np.uint64((1 << width) - 1)
        np.bitwise_or.at(out, word, v << shift)
        over = shift + np.uint64(width) > U64
        np.bitwise_or.at(out, word[over] + 1, v[over] >> (U64 - shift[over]))
    return out


def take_bits(words: np.ndarray, bit: np.ndarray, width: np.ndarray) -> np.ndarray:
    """So many bits from each position."""
    word, shift = bit >> 6, (bit & 63).view(np.uint64)
    high = words[word + 1] << U1 << (shift ^ np.uint64(63))  # by 64 - shift in two steps, as a shift by 64 is not defined
    return (words[word] >> shift | high) & (U1 << width) - U1


#: Every byte 1, its top bit; place of the r-th set bit of a byte b at r << 8 | b; bits above each bit of a word.
EACH, TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
HALVES = [np.uint64(x) for x in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F)]
IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for r in range(8) for b in range(256)], np.uint8)
ABOVE = np.array([(1 << 64) - (2 << k) for k in range(64)], np.uint64)


def nth_one(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th set bit of every word: its byte from the bytes' running sums, then a table."""
    r = r.astype(np.uint64)
    ones = x - (x >> U1 & HALVES[0])
    ones = (ones & HALVES[1]) + (ones >> np.uint64(2) & HALVES[1])
    ones = (ones + (ones >> np.uint64(4)) & HALVES[2]) * EACH
    at = np.bitwise_count((r * EACH | TOP) - ones & TOP).astype(np.uint64) << np.uint64(3)
    r -= ones << np.uint64(8) >> at & np.uint64(255)
    return at.view(np.int64) + IN_BYTE[(r << np.uint64(8) | x >> at & np.uint64(255)).view(np.int64)]


def ef_build(values: np.ndarray, prefix: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing unsigned sequence."""
    values = values.astype(np.uint64)
    n, most = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (most // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + (most >> width) + 2
    bit = high + np.arange(n)
    upper = np.zeros(size // 64 + 1, np.uint64)
    np.bitwise_or.at(upper, bit >> 6, U1 << (bit & 63).astype(np.uint64))
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper).astype(np.int64))])
    return {f"{prefix}.low": pack_bits(values, width), f"{prefix}.upper": upper, f"{prefix}.ones": ones, f"{prefix}.zeros": 64 * np.arange(len(ones)) - ones, f"{prefix}.shape": np.array([n, width, most >> width])}


def ef_join(levels: list[dict[str, np.ndarray]]) -> dict[str, list[np.ndarray]]:
    """Arrays of several files, in pieces one after the other; counts of set and unset bits go on from piece to piece."""
    out: dict[str, list[np.ndarray]] = {k: [a[k] for a in levels] for k in levels[0]}
    for k in out:
        if k.endswith((".ones", ".zeros")):
            base = np.cumsum([0, *(int(a[-1]) for a in out[k])])
            out[k] = [a[:-1] + b for a, b in zip(out[k], base)] + [base[-1:]]
    return out


class EliasFano:
    """A sequence, or several joined ones (segments): positions and values are those within the segment."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.low, self.upper, self.ones, self.zeros = (arrays[f"{prefix}.{k}"] for k in ("low", "upper", "ones", "zeros"))
        self.n, width, top = arrays[f"{prefix}.shape"].reshape(-1, 3).T
        before = lambda x: np.cumsum(x) - x
        self.first = before(self.n)
        self.zero = 64 * before((self.n + top + 2) // 64 + 1) - self.first
        self.low_at = 64 * before(self.n * width // 64 + 2)
        self.width, self.top = width.astype(np.uint64), top.astype(np.uint64)

    def _select(self, count: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(count, k, side="right") - 1
        x = self.upper[word]
        return word * 64 + nth_one(~x if flip else x, k - count[word])

    def get(self, i: np.ndarray, segment: np.ndarray | int = 0) -> np.ndarray:
        """Values at the positions i."""
        k, width = i + self.first[segment], self.width[segment]
        high = (self._select(self.ones, k, False) - k - self.zero[segment]).astype(np.uint64)
        return high << width | take_bits(self.low, self.low_at[segment] + i * width.astype(np.int64), width)

    def _bounds(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many values are before the k-th zero and the one before it, which enclose those of a high part."""
        before = self._select(self.zeros, np.maximum(k - 1, 0), True)
        rest = ~self.upper[before >> 6] & ABOVE[before & 63]
        after = (before & ~63) + np.bitwise_count((rest & (~rest + U1)) - U1)
        far = np.flatnonzero((rest == 0) | (k == 0))
        if far.size:
            after[far] = self._select(self.zeros, k[far], True)
        return np.where(k > 0, before - k + 1, 0), after - k

    def _search(self, x: np.ndarray, segment: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value >= x, by a jump to x's high part and a search over the low parts, and whether it is x."""
        x, segment = x.astype(np.uint64), np.zeros(len(x), np.int64) if segment is None else segment
        width, first = self.width[segment], self.first[segment]
        high = x >> width
        inside = high <= self.top[segment]
        lo, hi = self._bounds(self.zero[segment] + np.where(inside, high, 0).astype(np.int64))
        lo, hi = lo - first, hi - first
        want, end, at, wide = x & (U1 << width) - U1, hi.copy(), self.low_at[segment], width.astype(np.int64)
        live = np.flatnonzero(lo < hi)
        while live.size:
            l, h = lo[live], hi[live]
            mid = (l + h) >> 1
            less = take_bits(self.low, at[live] + mid * wide[live], width[live]) < want[live]
            lo[live] = l = np.where(less, mid + 1, l)
            hi[live] = h = np.where(less, h, mid)
            live = live[l < h]
        equal = np.flatnonzero(inside & (lo < end))  # the high part is x's
        is_x = np.zeros(len(x), bool)
        is_x[equal] = take_bits(self.low, at[equal] + lo[equal] * wide[equal], width[equal]) == want[equal]
        return np.where(inside, lo, self.n[segment]), is_x

    def successor(self, x: np.ndarray, segment: np.ndarray | None = None) -> np.ndarray:
        """Position of the first value >= x."""
        return self._search(x, segment)[0]

    def find(self, x: np.ndarray, segment: np.ndarray | None = None) -> np.ndarray:
        """Position of x, -1 where it is absent."""
        at, is_x = self._search(x, segment)
        return np.where(is_x, at, -1)


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI: local ones and those that pyarrow knows (hdfs, s3, gs, ...)."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), where.path
    return fs.FileSystem.from_uri(path)


def save(path: str, arrays: dict[str, np.ndarray | list[np.ndarray]]) -> None:
    """One file with all arrays, whole or in pieces; written aside and moved, so a task that runs twice leaves one whole file."""
    store, path = resolve(path)
    head, at = {}, 0
    pieces = {k: a if isinstance(a, list) else [a] for k, a in arrays.items()}
    for k, a in pieces.items():
        head[k] = [a[0].dtype.str, sum(map(len, a)), at]
        at += -(-sum(x.nbytes for x in a) // 64) * 64
    text = json.dumps(head).encode()
    text = len(text).to_bytes(8, "little") + text
    store.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as f:
        f.write(text + b"\0" * (-len(text) % 64))
        for a in pieces.values():
            for x in a:
                f.write(x.tobytes())
            f.write(b"\0" * (-sum(x.nbytes for x in a) % 64))
    store.move(aside, path)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped where the path is mounted, else read whole."""
    store, path = resolve(path)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain array over the map: slices of a memmap cost more than look-ups
    else:
        with store.open_input_file(path) as f:
            raw = np.frombuffer(f.read_buffer(), np.uint8)
    n = int(raw[:8].view("<u8")[0])
    head = json.loads(raw[8 : 8 + n].tobytes())
    base = -(-(8 + n) // 64) * 64
    return {k: raw[base + at : base + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, size, at) in head.items()}
