"""A cuckoo filter in numpy (Fan et al., "Cuckoo Filter: Practically Better Than Bloom", 2014).

Buckets of four 16-bit fingerprints; a key may lie in two buckets, each found from the
other and the fingerprint, so keys can be deleted. All steps take arrays of keys.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
LOAD = 0.8
_ROUNDS = 500


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rank_in_run(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by value, and each ordered item's place among its equals."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    return order, np.arange(len(v)) - np.repeat(starts, np.diff(np.r_[starts, len(v)]))


class CuckooFilter:
    """Insert each key once; ``contains`` never misses one that was inserted and not deleted."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def for_keys(cls, count: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, count) / (SLOTS * LOAD)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    def __len__(self) -> int:
        return int(np.count_nonzero(self.table))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = _mix(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        return prints, (mixed & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (_mix(prints) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one = self._places(keys)
        two = self._other(prints, one)
        wanted = prints[:, None]
        return (self.table[one] == wanted).any(axis=1) | (self.table[two] == wanted).any(axis=1)

    def _fill(self, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts what fits into free slots; returns which items are left."""
        order, rank = _rank_in_run(bucket)
        b = bucket[order]
        free = self.table[b] == 0
        fits = rank < free.sum(axis=1)
        slot = np.argmax((np.cumsum(free, axis=1) == rank[:, None] + 1) & free, axis=1)
        self.table[b[fits], slot[fits]] = prints[order[fits]]
        left = np.ones(len(prints), bool)
        left[order[fits]] = False
        return left

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; it then has to be rebuilt with more buckets."""
        prints, bucket = self._places(keys)
        draws = np.random.default_rng(0)
        for turn in range(_ROUNDS):
            if not len(prints):
                return True
            left = self._fill(prints, bucket)
            prints, bucket = prints[left], bucket[left]
            if turn == 0:
                bucket = self._other(prints, bucket)
                continue
            # one item of each full bucket takes a slot; what lay there moves to its other bucket
            order, rank = _rank_in_run(bucket)
            kick = order[rank == 0]
            slot = draws.integers(0, SLOTS, len(kick))
            out = self.table[bucket[kick], slot]
            self.table[bucket[kick], slot] = prints[kick]
            prints[kick] = out
            bucket[kick] = self._other(out, bucket[kick])
        return not len(prints)

    def delete(self, keys: np.ndarray) -> None:
        """Removes one fingerprint for each key; only keys that were inserted may be deleted."""
        prints, bucket = self._places(keys)
        for _ in range(2):
            while len(prints):
                match = self.table[bucket] == prints[:, None]
                order, rank = _rank_in_run(bucket << 16 | prints)
                ready = order[rank == 0]
                ready = ready[match[ready].any(axis=1)]
                if not len(ready):
                    break
                self.table[bucket[ready], np.argmax(match[ready], axis=1)] = 0
                stay = np.ones(len(prints), bool)
                stay[ready] = False
                prints, bucket = prints[stay], bucket[stay]
            bucket = self._other(prints, bucket)


def build(keys: np.ndarray) -> CuckooFilter:
    """A filter of these distinct keys, with as many buckets as the insertion needs."""
    room = len(keys)
    while True:
        made = CuckooFilter.for_keys(room)
        if made.insert(keys):
            return made
        room *= 2
