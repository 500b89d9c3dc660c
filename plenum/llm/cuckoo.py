"""A cuckoo filter (Fan et al., 2014) over 64-bit hashes in numpy: insert, look up, delete."""

from __future__ import annotations

import numpy as np

_SLOTS, _KICKS = 4, 500


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; zero is an empty slot."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @classmethod
    def of_capacity(cls, n: int) -> CuckooFilter:
        """An empty filter that n items fill to 80 % at most."""
        buckets = 1
        while buckets * _SLOTS * 0.8 < max(n, 8):
            buckets *= 2
        return cls(np.zeros((buckets, _SLOTS), dtype=np.uint16))

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, dtype=np.uint16).reshape(-1, _SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def _prints(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return (bucket ^ (prints.astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints, first = self._prints(hashes), hashes & self.mask
        return prints, first, self._other(first, prints)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash whether it may be in the filter; never false for one that is."""
        prints, first, second = self._places(hashes)
        return (self.table[first] == prints[:, None]).any(axis=1) | (self.table[second] == prints[:, None]).any(axis=1)

    def _settle(self, buckets: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Puts prints in free slots of their buckets; returns which found none."""
        order = np.argsort(buckets, kind="stable")
        at = buckets[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at, side="left")
        free = self.table[at] == 0
        fits = rank < free.sum(axis=1)
        nth = np.cumsum(free, axis=1) == (rank + 1)[:, None]
        slot = np.argmax(nth & free, axis=1)
        self.table[at[fits], slot[fits]] = prints[order[fits]]
        left = np.ones(len(buckets), dtype=bool)
        left[order[fits]] = False
        return left

    def insert(self, hashes: np.ndarray) -> np.ndarray:
        """Inserts the hashes; returns a mask of those for which there was no room and which are not in the filter."""
        prints, first, second = self._places(hashes)
        left = np.flatnonzero(self._settle(first, prints))
        left = left[self._settle(second[left], prints[left])]
        refused = np.zeros(len(hashes), dtype=bool)
        for i in left:
            refused[i] = not self._kick(int(second[i]), int(prints[i]))
        return refused

    def _kick(self, bucket: int, carried: int) -> bool:
        """Moves prints along to make room; undone if there is none."""
        moved = []
        for k in range(_KICKS):
            row = self.table[bucket]
            if (empty := np.flatnonzero(row == 0)).size:
                row[empty[0]] = carried
                return True
            slot = (k * 7 + carried) % _SLOTS
            moved.append((bucket, slot, int(row[slot])))
            row[slot], carried = carried, int(row[slot])
            bucket = int(self._other(np.uint64(bucket), np.array(carried, dtype=np.uint16)))
        for bucket, slot, was in reversed(moved):
            self.table[bucket, slot] = was
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Removes one entry of each hash; each must have been inserted."""
        prints, first, second = self._places(hashes)
        for p, a, b in zip(prints, first, second):
            for bucket in (a, b):
                if (at := np.flatnonzero(self.table[bucket] == p)).size:
                    self.table[bucket, at[0]] = 0
                    break
