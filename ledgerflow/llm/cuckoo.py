"""A cuckoo filter over 16-byte keys: buckets of four 16-bit fingerprints, with deletion.

A key has two buckets, each found from the other by its fingerprint, so a fingerprint can be
moved or removed without the key. ``add`` answers False when no place is found; the caller
then rebuilds a larger filter from the exact table that backs it.
"""

from __future__ import annotations

import numpy as np

SLOTS, MAX_MOVES, LOAD = 4, 500, 0.8


def _split(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket hash, fingerprint 1 .. 65535) of each key, from its first 12 bytes. The bytes
    behind the first four choose them, as the first four choose the shard."""
    a = np.frombuffer(b"".join(k[4:16] for k in keys), dtype="<u4").reshape(-1, 3)
    return a[:, 0].astype(np.uint64), (a[:, 1] % np.uint32(65535) + np.uint32(1)).astype(np.uint16)


def _step(fp):
    return (np.asarray(fp, dtype=np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)


class CuckooFilter:
    def __init__(self, buckets: int):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.table = np.zeros((buckets, SLOTS), dtype=np.uint16)

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        """A filter that holds ``keys``, as large as it takes."""
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * LOAD)))))
        while True:
            out = cls(buckets)
            if all(out.add(k) for k in keys):
                return out
            buckets *= 2

    def _places(self, keys: list[bytes]):
        h, fp = _split(keys)
        mask = np.uint64(len(self.table) - 1)
        one = h & mask
        return one.astype(np.int64), ((one ^ _step(fp)) & mask).astype(np.int64), fp

    def add(self, key: bytes) -> bool:
        one, two, fp = (x[0] for x in self._places([key]))
        for b in (one, two):
            free = np.flatnonzero(self.table[b] == 0)
            if len(free):
                self.table[b, free[0]] = fp
                return True
        at, trail = int(two), []
        for move in range(MAX_MOVES):
            slot = move % SLOTS
            trail.append((at, slot, self.table[at, slot]))
            fp, self.table[at, slot] = self.table[at, slot], fp
            at = int((np.uint64(at) ^ _step(fp)) & np.uint64(len(self.table) - 1))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fp
                return True
        for at, slot, old in reversed(trail):                  # leave the filter as it was
            self.table[at, slot] = old
        return False

    def remove(self, key: bytes) -> bool:
        """Remove one key that was added before."""
        one, two, fp = (x[0] for x in self._places([key]))
        for b in (one, two):
            slot = np.flatnonzero(self.table[b] == fp)
            if len(slot):
                self.table[b, slot[0]] = 0
                return True
        return False

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """True where a key may be in the filter, False where it is not."""
        if not keys:
            return np.zeros(0, dtype=bool)
        one, two, fp = self._places(keys)
        return ((self.table[one] == fp[:, None]) | (self.table[two] == fp[:, None])).any(axis=1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> CuckooFilter:
        out = cls(len(blob) // (2 * SLOTS))
        out.table = np.frombuffer(blob, dtype=np.uint16).reshape(-1, SLOTS).copy()
        return out
