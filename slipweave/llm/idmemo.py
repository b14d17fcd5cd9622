"""A bounded memo from byte strings to runs of ids, kept in arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, `size` of them, one range after the other."""
    upto = np.cumsum(size, dtype=np.int64)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if total < 1 << 31 and (not len(start) or int(start.max()) < 1 << 30) else np.int64
    out = np.repeat((start - upto + size).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


def _strings(words: pa.Array) -> list[bytes]:
    """What to_pylist() gives for strings without nulls, in a fifth of its time."""
    _, ends, data = words.buffers()
    if not len(words):
        return []
    upto = np.frombuffer(ends, np.int32)[words.offset:words.offset + len(words) + 1]
    raw = data[upto[0]:upto[-1]].to_pybytes() if data else b""
    upto = (upto - upto[0]).tolist()
    return [raw[a:b] for a, b in zip(upto, upto[1:])]


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(hash, _strings(words)), np.int64, len(words))


class IdMemo:
    """Known strings, the number of ids of each, and all their ids back to back. When it
    would hold more than `most`, it keeps what the strings at hand have of it."""

    def __init__(self, most: int):
        self.most = most
        self.known, self.sizes, self.flat = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _find(self, words: pa.Array) -> np.ndarray:
        """Where strings are among the known ones, or -1."""
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy().copy()

    def _keep(self, mine: np.ndarray) -> None:
        """Only these of the known strings, in this order."""
        start = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.flat = self.flat[ranges(start[mine], self.sizes[mine])]
        self.known, self.sizes = self.known.take(pa.array(mine)), self.sizes[mine]

    def _add(self, fresh: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.known = pa.concat_arrays([self.known, fresh])
        self.sizes = np.concatenate([self.sizes, sizes]).astype(np.int32)
        self.flat = np.concatenate([self.flat, flat])

    def _places(self, words: pa.Array, solve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Where different strings are among the known ones, which they join."""
        at = self._find(words)
        new = at < 0
        if not new.any():
            return at
        if len(self.known) + new.sum() > self.most:
            mine = np.sort(at[~new])
            self._keep(mine)
            at[~new] = np.searchsorted(mine, at[~new])
        at[new] = len(self.known) + np.arange(new.sum())
        fresh = words.filter(pa.array(new))
        self._add(fresh, *solve(_strings(fresh)))
        return at

    def ids(self, data: bytes | np.ndarray, starts: np.ndarray, solve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number) of the strings that begin at `starts` and lie back to back in
        `data`; solve() gives the number of ids of some strings, and all their ids."""
        offsets = np.r_[starts, len(data)].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        which = self._places(found.dictionary, solve)[found.indices.to_numpy()]
        n = self.sizes[which]
        return self.flat[ranges((np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[which], n)], n


class HashedMemo(IdMemo):
    """The same, with its strings found by hashes in an open table that grows with them; the
    other one hashes all it knows at each call. Bytes decide: a string whose hash is that of
    another one counts as new."""

    def __init__(self, most: int):
        super().__init__(most)
        self.hashes, self.table = np.zeros(0, np.int64), np.full(1 << 12, -1, np.int32)

    def _enter(self, first: int) -> None:
        """Puts the strings from `first` on into the table, which stays half empty."""
        if 2 * len(self.hashes) > len(self.table):
            self.table = np.zeros(0, np.int32)  # before the larger one is there
            self.table, first = np.full(1 << (4 * len(self.hashes)).bit_length(), -1, np.int32), 0
        todo, mask = np.arange(first, len(self.hashes), dtype=np.int32), len(self.table) - 1
        slot = self.hashes[first:] & mask
        while len(todo):
            free = self.table[slot] < 0
            self.table[slot[free]] = todo[free]
            left = self.table[slot] != todo
            todo, slot = todo[left], slot[left] + 1 & mask

    def _find(self, words: pa.Array) -> np.ndarray:
        at = np.full(len(words), -1, np.int32)
        if not len(self.hashes):
            return at
        own, mask = _hashes(words), len(self.table) - 1
        todo, slot = np.arange(len(words)), own & mask
        while len(todo):
            there = self.table[slot]
            same = (there >= 0) & (self.hashes[there] == own[todo])
            at[todo[same]] = there[same]
            on = (there >= 0) & ~same
            todo, slot = todo[on], slot[on] + 1 & mask
        hit = np.flatnonzero(at >= 0)
        equal = pc.equal(self.known.take(pa.array(at[hit])), words.take(pa.array(hit)))
        at[hit[~equal.to_numpy(zero_copy_only=False)]] = -1
        return at

    def _keep(self, mine: np.ndarray) -> None:
        super()._keep(mine)
        self.hashes = self.hashes[mine]
        self.table.fill(-1)
        self._enter(0)

    def _add(self, fresh: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        super()._add(fresh, sizes, flat)
        first = len(self.hashes)
        self.hashes = np.concatenate([self.hashes, _hashes(fresh)])
        self._enter(first)
