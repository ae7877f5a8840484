"""A cuckoo filter over 64-bit hashes: set membership with deletion, in two bytes a slot.

A hash has a fingerprint of 16 bits and two buckets of ``SLOTS`` slots; each bucket follows from the
other and the fingerprint. What finds no place after ``TURNS`` rounds of moving goes to a stash, so
no hash is ever lost. Hashes may be inserted several times and are deleted once each.
"""

from __future__ import annotations

import numpy as np

SLOTS = 4
TURNS = 200
LOAD = 0.85
_U = np.uint64


def _spread(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x * _U(0x9E3779B97F4A7C15)
        return z ^ (z >> _U(29))


class Cuckoo:
    def __init__(self, table: np.ndarray, stash: np.ndarray):
        self.table, self.stash = table, stash

    @classmethod
    def sized(cls, n: int) -> Cuckoo:
        """Empty, with room for ``n`` hashes."""
        buckets = 1 << max(0, int(np.ceil(n / (SLOTS * LOAD))) - 1).bit_length()
        return cls(np.zeros((buckets, SLOTS), np.uint16), np.zeros(0, _U))

    @classmethod
    def loads(cls, data: bytes) -> Cuckoo:
        buckets = int(np.frombuffer(data, np.int64, 1)[0])
        table = np.frombuffer(data, np.uint16, buckets * SLOTS, 8).reshape(buckets, SLOTS)
        return cls(table.copy(), np.frombuffer(data, _U, offset=8 + table.nbytes).copy())

    def dumps(self) -> bytes:
        return np.int64(len(self.table)).tobytes() + self.table.tobytes() + self.stash.tobytes()

    def _print(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _U(40)) % _U(65535) + _U(1)).astype(np.uint16)

    def _first(self, h: np.ndarray) -> np.ndarray:
        return (_spread(h) & _U(len(self.table) - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return at ^ (_spread(fp.astype(_U)) >> _U(17) & _U(len(self.table) - 1)).astype(np.int64)

    def _stashed(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """One number for a fingerprint and its pair of buckets."""
        return np.minimum(at, self._other(at, fp)).astype(_U) << _U(16) | fp.astype(_U)

    def insert(self, h: np.ndarray) -> None:
        """All at once: in each turn the pending ones of a bucket take its free slots; the rest go on to their other bucket."""
        fp, at = self._print(h), self._first(h)
        for turn in range(TURNS):
            if not len(fp):
                return
            order = np.argsort(at, kind="stable")
            fp, at = fp[order], at[order]
            _, first, run = np.unique(at, return_index=True, return_inverse=True)
            place = np.arange(len(at)) - first[run]
            free = self.table[at] == 0
            fits = place < free.sum(axis=1)
            slot = np.argmax(np.cumsum(free, axis=1) == (place + 1)[:, None], axis=1)
            self.table[at[fits], slot[fits]] = fp[fits]
            fp, at = fp[~fits], at[~fits]
            at = self._other(at, fp)
            if turn % 2:  # one of each bucket takes the place of another, which goes on
                _, one = np.unique(at, return_index=True)
                slot = (fp[one] + turn) % SLOTS
                out = self.table[at[one], slot]
                self.table[at[one], slot] = fp[one]
                fp[one] = out
                at[one] = self._other(at[one], out)
                fp, at = fp[fp > 0], at[fp > 0]
        self.stash = np.concatenate([self.stash, self._stashed(at, fp)])

    def contains(self, h: np.ndarray) -> np.ndarray:
        fp, at = self._print(h), self._first(h)
        found = (self.table[at] == fp[:, None]).any(axis=1) | (self.table[self._other(at, fp)] == fp[:, None]).any(axis=1)
        return found | np.isin(self._stashed(at, fp), self.stash) if len(self.stash) else found

    def delete(self, h: np.ndarray) -> None:
        """Each of ``h`` must have been inserted."""
        fp, at = self._print(h), self._first(h)
        while len(fp):
            here = (self.table[at] == fp[:, None]).any(axis=1)
            bucket = np.where(here, at, self._other(at, fp))
            match = self.table[bucket] == fp[:, None]
            _, one = np.unique(bucket * (1 << 16) + fp, return_index=True)  # of equal ones a slot a turn
            held = match[one].any(axis=1)
            self.table[bucket[one[held]], np.argmax(match[one[held]], axis=1)] = 0
            for x in self._stashed(at[one[~held]], fp[one[~held]]):
                place = np.flatnonzero(self.stash == x)
                if not len(place):
                    raise KeyError("a hash to delete is not in the filter")
                self.stash = np.delete(self.stash, place[0])
            left = np.ones(len(fp), bool)
            left[one] = False
            fp, at = fp[left], at[left]
