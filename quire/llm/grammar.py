"""Re-Pair grammars over arrays of token ids, and their file format.

A shard holds the ids of a run of documents. Frequent pairs of neighbouring symbols are replaced by new
symbols (nonterminals), round after round; pairs never cross the end of a document, so that every document
is a range of symbols and can be decoded alone. With each rule goes the number of ids it expands to, which
finds a place inside a document without decoding what stands before it.

Bytes of a shard (little-endian): ``RPG1``; uint32 first nonterminal, rules, documents, bytes per symbol
(2 or 4); uint64 symbols; uint32 pairs of the rules; uint32 expansion lengths; uint64 first symbol of each
document, and the number of symbols; the symbols.
"""

from __future__ import annotations

import struct

import numpy as np

ROUNDS = 4
PAIRS_PER_ROUND = 1024
LEAST_COUNT = 16  # a rule that replaces fewer pairs does not pay
_BINS = 20
_HEAD = "<4sIIIIQ"
_MAGIC = b"RPG1"


def _frequent(key: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent keys, where they may stand, and which of them stands there.

    Counts by hash first. Each frequent bin then names one of its keys, whose places are counted; a key that
    shares its bin with that one waits for a later round.
    """
    bins = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BINS)).view(np.int64)
    counts = np.bincount(bins, minlength=1 << _BINS) - np.bincount(bins[~allowed], minlength=1 << _BINS)
    # the least count of the most frequent bins
    at_least = np.cumsum(np.bincount(np.minimum(counts, 1 << 16))[::-1])[::-1]
    floor = max(LEAST_COUNT, int(np.count_nonzero(at_least >= most)) - 1)
    frequent = np.flatnonzero(counts >= floor)
    number = np.full(1 << _BINS, -1, np.int32)
    number[frequent] = np.arange(len(frequent), dtype=np.int32)
    places = np.flatnonzero(allowed & (number >= 0)[bins])
    which, found = number[bins[places]], key[places]
    named = np.zeros(len(frequent), np.uint64)
    named[which[::-1]] = found[::-1]  # the first in the shard
    own = named[which] == found
    places, which = places[own], which[own]
    each = np.bincount(which, minlength=len(frequent))
    order = np.lexsort((named, -each))[:most]
    chosen = np.sort(order[each[order] >= LEAST_COUNT])
    rank = np.full(len(frequent), -1, np.int64)
    rank[chosen] = np.arange(len(chosen))
    stands = rank[which] >= 0
    return named[chosen], places[stands], rank[which[stands]]


def compress(
    ids: np.ndarray, ends: np.ndarray, first_new: int, rounds: int = ROUNDS, most: int = PAIRS_PER_ROUND
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (n x 2) and first symbols of documents. ``ends``: end place of each document in ``ids``."""
    symbols = ids.astype(np.uint64)
    last = np.zeros(len(ids), bool)
    filled = ends[np.diff(ends, prepend=0) > 0]
    last[filled - 1] = True
    rules = []
    n_rules = 0
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        key = (symbols[:-1] << np.uint64(32)) | symbols[1:]
        chosen, places, rank = _frequent(key, ~last[:-1], most)
        if len(chosen) == 0:
            break
        # of overlapping pairs every other one, from the left
        starts = np.flatnonzero(np.r_[True, np.diff(places) > 1])
        within = np.arange(len(places)) - np.repeat(starts, np.diff(np.r_[starts, len(places)]))
        places, rank = places[within % 2 == 0], rank[within % 2 == 0]
        symbols[places] = (first_new + n_rules + rank).astype(np.uint64)
        last[places] = last[places + 1]
        stay = np.ones(len(symbols), bool)
        stay[places + 1] = False
        symbols, last = symbols[stay], last[stay]
        rules.append(np.stack([chosen >> np.uint64(32), chosen & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
        n_rules += len(chosen)
    closed = np.flatnonzero(last) + 1
    stops = np.zeros(len(ends), np.int64)
    stops[np.diff(ends, prepend=0) > 0] = closed
    stops = np.maximum.accumulate(stops) if len(stops) else stops
    all_rules = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return symbols.astype(np.uint32), all_rules, np.r_[0, stops]


def _expansions(rules: np.ndarray, first_new: int) -> list[np.ndarray]:
    whole: list[np.ndarray] = []
    for a, b in rules.tolist():
        parts = [whole[x - first_new] if x >= first_new else np.array([x], np.uint32) for x in (a, b)]
        whole.append(np.concatenate(parts))
    return whole


def pack(ids: np.ndarray, ends: np.ndarray, first_new: int, rounds: int = ROUNDS, most: int = PAIRS_PER_ROUND) -> bytes:
    symbols, rules, firsts = compress(ids, ends, first_new, rounds, most)
    lengths = np.array([len(x) for x in _expansions(rules, first_new)], np.uint32)
    width = 2 if first_new + len(rules) <= 1 << 16 else 4
    head = struct.pack(_HEAD, _MAGIC, first_new, len(rules), len(ends), width, len(symbols))
    body = symbols.astype("<u2" if width == 2 else "<u4")
    return b"".join([head, rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), firsts.astype("<u8").tobytes(), body.tobytes()])


class Shard:
    """A packed shard, opened for decoding."""

    def __init__(self, data: bytes):
        magic, self.first_new, n_rules, self.n_docs, width, n_symbols = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a shard")
        at = struct.calcsize(_HEAD)
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.lengths = np.frombuffer(data, "<u4", n_rules, at)
        at += 4 * n_rules
        self.firsts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.symbols = np.frombuffer(data, "<u2" if width == 2 else "<u4", n_symbols, at)
        flat = [np.arange(self.first_new, dtype=np.uint32), *_expansions(self.rules, self.first_new)]
        self._flat = np.concatenate(flat)
        self._length = np.r_[np.ones(self.first_new, np.int64), self.lengths.astype(np.int64)]
        self._start = np.r_[0, np.cumsum(self._length)[:-1]]

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return gather(self._flat, self._start, self._length, symbols)

    def counts(self) -> np.ndarray:
        """Ids of each document."""
        total = np.r_[0, np.cumsum(self._length[self.symbols])]
        return total[self.firsts[1:]] - total[self.firsts[:-1]]

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        return self._expand(self.symbols)

    def document(self, number: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of one document; only the symbols that hold them are expanded."""
        symbols = self.symbols[self.firsts[number] : self.firsts[number + 1]]
        ends = np.cumsum(self._length[symbols])
        total = int(ends[-1]) if len(ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.empty(0, np.uint32)
        a, b = np.searchsorted(ends, [start, stop - 1], side="right")
        before = int(ends[a - 1]) if a else 0
        return self._expand(symbols[a : b + 1])[start - before : stop - before]


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The ranges of ``flat`` that ``entries`` stand for, one after the other."""
    counts = lengths[entries]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[entries] - (ends - counts), counts) + np.arange(total)]
