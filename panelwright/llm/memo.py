"""What a worker remembers of strings: arrays of numbers by 128-bit hash, bounded, those in use kept."""

from __future__ import annotations

import numpy as np
import xxhash


def digests(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw)), "<u8").reshape(-1, 2)


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions start[0], start[0]+1, ... of all runs, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class HashMemo:
    """Flat arrays; beyond ``most`` entries those that were not asked for since the last sweep go.

    A bound on memory, not on results: what is forgotten is worked out again.
    """

    def __init__(self, most: int, kind: str = "<u4"):
        self.most, self.kind = most, kind
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.data = np.zeros(0, self.kind)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of every hash, -1 where it is not known."""
        at = np.searchsorted(self.key, h[:, 0])
        at[at == len(self.key)] = -1
        ok = at >= 0
        ok[ok] = (self.key[at[ok]] == h[ok, 0]) & (self.check[at[ok]] == h[ok, 1])
        self.used[at[ok]] = True
        return np.where(ok, at, -1)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the entries, one entry's after the other, and how many each has."""
        size = self.size[at].astype(np.int64)
        return self.data[spread(self.start[at], size)], size

    def add(self, h: np.ndarray, size: np.ndarray, data: np.ndarray) -> None:
        if len(self.key) + len(h) > self.most:
            self.sweep()
        key = np.concatenate([self.key, h[:, 0]])
        order = np.argsort(key, kind="stable")  # two runs, nearly sorted
        self.key, self.check = key[order], np.concatenate([self.check, h[:, 1]])[order]
        start = len(self.data) + np.cumsum(size) - size
        self.start, self.size = np.concatenate([self.start, start])[order], np.concatenate([self.size, size.astype(np.int32)])[order]
        self.used = np.append(self.used, np.zeros(len(h), bool))[order]
        self.data = np.concatenate([self.data, data.astype(self.kind)])

    def sweep(self) -> None:
        keep = np.flatnonzero(self.used)
        if 2 * len(keep) > self.most:
            self.clear()
            return
        self.data, size = self.take(keep)
        self.key, self.check, self.size = self.key[keep], self.check[keep], self.size[keep]
        self.start, self.used = np.cumsum(size) - size, np.zeros(len(keep), bool)

