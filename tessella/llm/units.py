"""Whole texts encoded unit by unit: a unit is a run of white space with the run of other characters after it.

Neither tokenizer here joins characters across the start of a unit, so a text's ids are those of its units in turn, and
each distinct unit is encoded once by the library and then looked up. Rows where that may not hold (the caller's odd
rows) are encoded whole. Units are told apart by a 64-bit hash of their bytes and length.

What is known lies in flat arrays (a slot of 12 bytes twice a unit and its ids), not in objects, so a million units take
some 40 MB and all units of a piece are looked up at once. Beyond CACHE units the table starts anew: that costs time only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .bytesops import buffers, pieces, span_hashes

CACHE = 1 << 20
PIECE = 2 << 20
JOIN = 256


class UnitTable:
    """Open addressing from 64-bit keys to runs of ids."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.entry = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.start, self.ids, self.count = np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's entry, -1 where it is not known."""
        slot, out, at = self._slot(keys), np.full(len(keys), -1, np.int32), None
        while True:
            e = self.entry[slot]
            same = (self.keys[slot] == keys) & (e >= 0)
            if at is None:
                out[same], open_ = e[same], np.flatnonzero(~same & (e >= 0))
                at = open_
            else:
                out[at[same]], open_ = e[same], np.flatnonzero(~same & (e >= 0))
                at = at[open_]
            if not len(at):
                return out
            slot, keys = (slot[open_] + 1) & (len(self.keys) - 1), keys[open_]

    def _place(self, keys: np.ndarray, entry: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = entry[free]  # of several keys for a slot the last one has it
            mine = self.entry[slot] == entry
            self.keys[slot[mine]] = keys[mine]
            slot, keys, entry = (slot[~mine] + 1) & (len(self.keys) - 1), keys[~mine], entry[~mine]

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """keys: distinct and not known; ids: theirs in turn, sizes: how many each has."""
        upto = self.count + len(keys)
        if 2 * upto > len(self.keys):
            used = self.entry >= 0
            held, entry = self.keys[used], self.entry[used]
            slots = 1 << (4 * upto - 1).bit_length()
            self.keys, self.entry = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
            self._place(held, entry)
        end = self.start[self.count] + np.cumsum(sizes)
        if upto >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros(upto + 1, np.int64)])
        if end[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(int(end[-1]), np.int32)])
        self.ids[self.start[self.count] : end[-1]] = ids
        self.start[self.count + 1 : upto + 1] = end
        self._place(keys, np.arange(self.count, upto, dtype=np.int32))
        self.count = upto


class UnitEncoder:
    """encode: texts to lists of ids, by the library. spaces: bytes that begin a unit. odd: rows (of bytes and row offsets) to encode whole.

    unit: a unit's bytes to the text to encode. width: the bytes that each id stands for; with it, JOIN new units at a time
    are encoded as one text, which the library does in half the time, and told apart by the widths of their ids.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], spaces: bytes, odd: Callable[[np.ndarray, np.ndarray], np.ndarray], unit: Callable[[bytes], bytes] = bytes, width: np.ndarray | None = None):
        self.encode, self.odd, self.unit, self.width = encode, odd, unit, width
        self.space = np.zeros(256, bool)
        self.space[list(spaces)] = True
        self.known = UnitTable()

    def _alone(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode([self.unit(x).decode() for x in units])
        return np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64)

    def _joined(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for k in range(0, len(units), JOIN):
            some = units[k : k + JOIN]
            x = np.array(self.encode([b"".join(some).decode()])[0], np.int64)
            ends, wanted = np.cumsum(self.width[x]), np.cumsum([len(u) for u in some])
            at = np.searchsorted(ends, wanted)
            if not np.array_equal(ends[np.minimum(at, len(ends) - 1)], wanted):
                raise ValueError("an id runs across two units")
            ids.append(x)
            sizes.append(np.diff(at, prepend=-1))
        return np.concatenate(ids).astype(np.int32), np.concatenate(sizes)

    def _new(self, keys: np.ndarray, units: list[bytes]) -> None:
        """Encode units (with their keys) and keep them."""
        together = np.zeros(len(units), bool)
        if self.width is not None:  # what starts with a space and does not end in one is the same within a text
            flat, off = np.frombuffer(b"".join(units), np.uint8), np.cumsum([0, *(len(x) for x in units)])
            together = self.space[flat[off[:-1]]] & ~self.space[flat[off[1:] - 1]]
            together[self.odd(flat, off)] = False
        for how, chosen in ((self._joined, np.flatnonzero(together)), (self._alone, np.flatnonzero(~together))):
            if len(chosen):
                self.known.add(keys[chosen], *how([units[i] for i in chosen.tolist()]))

    def _entries(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.known.count > CACHE:
            self.known = UnitTable()
        entry = self.known.find(h)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            keys, at = np.unique(h[missing], return_index=True)
            data, at = raw.tobytes(), missing[at]
            self._new(keys, [data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            entry[missing] = self.known.find(h[missing])
        return entry

    def _piece(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(off) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        space = self.space[raw]
        begin = np.zeros(len(raw), bool)
        begin[1:] = space[1:] & ~space[:-1]
        begin[off[:-1][np.diff(off) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(raw))
        entry = self._entries(span_hashes(raw, starts, ends), raw, starts, ends)
        first = self.known.start[entry]
        sizes = self.known.start[entry + 1] - first
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.known.ids[np.repeat(first - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.searchsorted(starts, off)]

    def rows(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, each row's first id and the end) for ranges of rows."""
        raw, off = buffers(column)
        with np.errstate(over="ignore"):
            for i, j in pieces(off, PIECE):
                part, at = raw[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, first = self._piece(part, at)
                odd = self.odd(part, at).tolist()
                if odd:
                    whole = self.encode([part[at[r] : at[r + 1]].tobytes().decode() for r in odd])
                    rows = [ids[first[r] : first[r + 1]] for r in range(j - i)]
                    for r, x in zip(odd, whole):
                        rows[r] = np.array(x, np.int32)
                    ids, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
                yield i, j, ids, first


def rows_with(raw: np.ndarray, off: np.ndarray, marks: list[bytes]) -> np.ndarray:
    """Rows that hold one of the marks (2 or 3 bytes each); a mark of one's end and the next one's start is no matter, it only costs time."""
    lead = np.zeros(256, bool)
    lead[[m[0] for m in marks]] = True
    at = np.flatnonzero(lead[raw[:-1]])
    two = raw[at].astype(np.int64) << 8 | raw[at + 1]
    three = two << 8 | raw[np.minimum(at + 2, len(raw) - 1)]
    wanted = [[int.from_bytes(m, "big") for m in marks if len(m) == n] for n in (2, 3)]
    at = at[np.isin(two, wanted[0]) | np.isin(three, wanted[1])]
    return np.unique(np.searchsorted(off, at, "right") - 1)
