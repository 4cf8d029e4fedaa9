"""Vectorised merge rounds: byte-pair merging of many words at once in flat numpy arrays.

All words' symbols lie in one array. A round looks up every neighbouring pair, takes each word's
least pair rank by a segmented minimum, merges all of that word's leftmost, non-overlapping
occurrences together, compacts the array and puts aside words in which no pair is left.

Merging occurrences together equals merging them one by one only if a fresh symbol never forms a
pair that ranks as well as the merge that made it. Where a vocabulary breaks this, the merge is
marked, and the round asks what pairs its fresh symbols would form, one after the other from the left: a word's
occurrences after the first that makes such a pair wait for a later round.

Words over LONG symbols have many rounds, so theirs touch only the places that change: symbols are linked
to their neighbours, each rank holds the places of its pairs, and a round takes the least rank left in any
word and merges all its places in the same way. The array is compacted once, when no pair remains.
"""

from __future__ import annotations

import heapq
from itertools import chain

import numpy as np

LONG = 512
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WIDTH = np.int64(1 << 21)
#: Masks of the first k of eight bytes.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class PairTable:
    """(left, right) -> rank and merged symbol, in an open-addressed table of int64 keys."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, new: np.ndarray):
        n = len(left)
        self.rank, self.new = np.append(rank, NONE).astype(np.int32), np.append(new, -1).astype(np.int32)
        top = int(max(left.max(initial=0), right.max(initial=0), new.max(initial=0))) + 1
        least = np.full(top, NONE, np.int64)
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.alone = np.append(least[new] <= rank, False)  # a fresh symbol may form a pair of as good a rank
        bits = max(4, int(np.ceil(np.log2(max(n, 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, n, np.int64)
        keys = left.astype(np.int64) * _WIDTH + right
        todo, slot = np.arange(n), self._hash(keys)
        while len(todo):
            free = self.keys[slot] == -1
            first = np.unique(slot[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.keys[slot[taken]], self.at[slot[taken]] = keys[todo[taken]], todo[taken]
            rest = np.ones(len(todo), bool)
            rest[taken] = False
            todo, slot = todo[rest], slot[rest]
            slot = np.where(self.keys[slot] != -1, (slot + 1) & self.mask, slot)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair's merge; the last index stands for none."""
        keys = left.astype(np.int64) * _WIDTH + right
        slot = self._hash(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.at[slot], len(self.rank) - 1)
        more = np.flatnonzero((held != keys) & (held != -1))
        while len(more):
            slot = (slot[more] if len(slot) != len(more) else slot) + 1 & self.mask
            held, want = self.keys[slot], keys[more]
            hit = held == want
            out[more[hit]] = self.at[slot[hit]]
            go = ~hit & (held != -1)
            more, slot = more[go], slot[go]
        return out


def _until_better(table: PairTable, entry: np.ndarray, word: np.ndarray, left: np.ndarray, right: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Which of a round's merges, in order, come before a fresh symbol in their word forms a pair of as good a rank.

    `left` and `right` are the neighbours' symbols before the round, -1 for none; `follows` says that the left
    neighbour is the symbol that the merge before makes.
    """
    new = table.new[entry]
    left = np.where(follows, np.append(-1, new[:-1]), left)
    best = np.full(len(new), NONE, np.int64)
    for a, b in ((left, new), (new, right)):
        have = np.flatnonzero((a >= 0) & (b >= 0))
        best[have] = np.minimum(best[have], table.rank[table.find(a[have], b[have])])
    bad = best <= table.rank[entry]
    before = np.cumsum(bad) - bad
    head = np.ones(len(word), bool)
    head[1:] = word[1:] != word[:-1]
    start = np.flatnonzero(head)
    return before == np.repeat(before[start], np.diff(np.append(start, len(word))))


def merge_long(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """``merge_words`` by linked places: the work of a round is that of the merges it makes."""
    n, none = len(symbols), len(table.rank) - 1
    sym, word = symbols.astype(np.int32), np.repeat(np.arange(len(lengths)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(lengths)
    after[ends[lengths > 0] - 1] = n
    before[(ends - lengths)[lengths > 0]] = -1
    alive, entry = np.ones(n, bool), np.full(n, none)
    waiting: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def look(at: np.ndarray) -> None:
        """Find the pairs that begin at some places, and let them wait under their ranks."""
        right = after[at]
        entry[at] = none
        have = right < n
        at, right = at[have], right[have]
        entry[at] = table.find(sym[at], sym[right])
        at = at[entry[at] != none]
        rank = table.rank[entry[at]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        for part, first in zip(np.split(at, cuts := np.flatnonzero(np.diff(rank)) + 1), np.append(0, cuts).tolist(), strict=True):
            if len(part):
                r = int(rank[first])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

    look(np.arange(n))
    while ranks:
        r = heapq.heappop(ranks)
        at = np.unique(np.concatenate(waiting.pop(r)))
        at = at[alive[at] & (table.rank[entry[at]] == r)]
        if not len(at):
            continue
        place = np.arange(len(at))
        fresh = np.ones(len(at), bool)
        fresh[1:] = after[at[:-1]] != at[1:]
        take = ((place - np.maximum.accumulate(np.where(fresh, place, 0))) & 1) == 0
        if table.alone[entry[at]].any():
            some = at[take]
            end = after[after[some]]
            follows = np.zeros(len(some), bool)
            follows[1:] = end[:-1] == some[1:]
            beyond = np.where(end < n, sym[np.minimum(end, n - 1)], -1)
            keep = _until_better(table, entry[some], word[some], np.where(before[some] >= 0, sym[before[some]], -1), beyond, follows)
            if not keep.all():
                take[take] = keep
                waiting[r] = [at[~take]]  # those that overlap a merge are dropped then
                heapq.heappush(ranks, r)
        left = at[take]
        right = after[left]
        further = after[right]
        sym[left], after[left], alive[right], entry[right] = table.new[entry[left]], further, False, none
        inside = further < n
        before[further[inside]] = left[inside]
        back = before[left]
        look(np.unique(np.concatenate([left, back[back >= 0]])))
    return sym[alive], np.bincount(word[alive], minlength=len(lengths))


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word fully; the flat result and each word's number of symbols, in the same order."""
    n_words = len(lengths)
    out_len = np.zeros(n_words, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word of each symbol, symbol)
    word = np.repeat(np.arange(n_words), lengths)
    sym = symbols.astype(np.int32)
    long = lengths > LONG
    if long.any():
        mine = long[word]
        got, sizes = merge_long(sym[mine], lengths[long], table)
        parts.append((np.repeat(np.flatnonzero(long), sizes), got))
        word, sym = word[~mine], sym[~mine]
    while len(sym):
        n = len(sym)
        head = np.ones(n, bool)
        head[1:] = word[1:] != word[:-1]
        start = np.flatnonzero(head)
        at = np.full(n, len(table.rank) - 1)
        same = np.flatnonzero(~head) - 1  # places whose right neighbour is in the same word
        at[same] = table.find(sym[same], sym[same + 1])
        rank = table.rank[at]
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.append(start, n))
        live = np.repeat(least != NONE, size)
        if not live.all():
            parts.append((word[~live], sym[~live]))
            word, sym, at, rank = word[live], sym[live], at[live], rank[live]
            least, size = least[least != NONE], size[least != NONE]
            n = len(sym)
            if not n:
                break
            start = np.cumsum(size) - size
        chosen = rank == np.repeat(least, size)
        place = np.arange(n)
        fresh = chosen.copy()
        fresh[1:] &= ~chosen[:-1]
        take = chosen & (((place - np.maximum.accumulate(np.where(fresh, place, 0))) & 1) == 0)
        if table.alone[at[take]].any():
            some = np.flatnonzero(take)
            own = word[some]
            follows = np.zeros(len(some), bool)
            follows[1:] = (some[:-1] + 2 == some[1:]) & (own[:-1] == own[1:])
            back, end = np.maximum(some - 1, 0), np.minimum(some + 2, n - 1)
            left = np.where((some > 0) & (word[back] == own), sym[back], -1)
            right = np.where((some + 2 < n) & (word[end] == own), sym[end], -1)
            take[some] = _until_better(table, at[some], own, left, right, follows)
        hit = np.flatnonzero(take)
        sym[hit] = table.new[at[hit]]
        keep = np.ones(n, bool)
        keep[hit + 1] = False
        word, sym = word[keep], sym[keep]
    if not parts:
        return np.zeros(0, np.int32), out_len
    words, syms = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    out_len = np.bincount(words, minlength=n_words)
    return syms[np.argsort(words, kind="stable")], out_len


class _Index(dict):
    """A number for each unit; new units are also listed in `fresh`."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        return n


class UnitStore:
    """Units of text met before and their ids, so each is merged once; emptied beyond `limit` units or `size` bytes."""

    def __init__(self, encode, limit: int = 300_000, size: int = 64 << 20):  # noqa: ANN001
        self.encode, self.limit, self.size = encode, limit, size
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.flat, self.used, self.chars = np.zeros(1 << 16, np.int32), 0, 0
        self.offset, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, units: list[str]) -> None:
        flat, lengths = self.encode(units)
        n, m = len(self.index) - len(units), len(units)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[n : n + m] = lengths
        self.offset[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.chars += sum(map(len, units))

    def ids(self, units: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The flat ids of all lists of units, and each list's number of ids."""
        if len(self.index) > self.limit or 4 * (self.used + self.chars) > self.size:
            self.clear()
        every = list(chain.from_iterable(units))
        at = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        if self.index.fresh:
            self.add(self.index.fresh)
            self.index.fresh = []
        if not len(at):
            return np.zeros(0, np.int32), np.zeros(len(units), np.int64)
        size = self.length[at]
        ends = np.cumsum(size)
        flat = self.flat[np.repeat(self.offset[at] - (ends - size), size) + np.arange(ends[-1])]
        last = np.cumsum([len(x) for x in units])
        upto = np.append(0, ends)[last]
        return flat, np.diff(np.append(0, upto))


class SpanStore:
    """``UnitStore`` for units that are spans of bytes: met ones are found by 128 bits of hash, many at a time in numpy.

    Spans over WIDEST bytes are not remembered, and no span is decoded twice while it is. The store is emptied when
    the distinct new spans of a step no longer fit.
    """

    WIDEST = 64
    #: Spans of a step: what it makes stays small.
    STEP = 1 << 16

    def __init__(self, encode, bits: int = 20):  # noqa: ANN001
        self.encode, self.limit, self.shift, self.mask = encode, 1 << (bits - 1), np.uint64(64 - bits), (1 << bits) - 1
        rng = np.random.default_rng(17)
        self.odd = rng.integers(1, 2**63, (2, 3), dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.clear()

    def clear(self) -> None:
        self.slots, self.n, self.used = np.full(self.mask + 1, -1, np.int32), 0, 0
        self.keys = np.zeros((2, 1 << 14), np.uint64)
        self.offset, self.length, self.flat = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 16, np.int32)

    def hashes(self, eights: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Two keys of each span, mixed from its length and eight bytes at a time; `eights` holds those from each place on."""
        out = lengths.astype(np.uint64) * self.odd[:, :1]
        at, done = slice(None), 0
        while True:
            left = lengths[at] - done
            x = eights[heads[at] + done] & _BYTES[np.minimum(left, 8)]
            for k, turn in enumerate((32, 29)):
                h = (out[k, at] ^ x) * self.odd[k, 1]
                out[k, at] = h ^ (h >> np.uint64(turn))
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            at, done = more if done == 0 else at[more], done + 8
        out *= self.odd[:, 2:]
        return out ^ (out >> np.uint64(31))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each unit met before; -1 for others."""
        out = np.full(keys.shape[1], -1, np.int64)
        todo, slot = np.arange(keys.shape[1]), (keys[0] >> self.shift).astype(np.int64)
        while len(todo):
            at = self.slots[slot]
            full = at >= 0
            hit = full & (self.keys[0][at] == keys[0][todo]) & (self.keys[1][at] == keys[1][todo])
            out[todo[hit]] = at[hit]
            go = full & ~hit
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out

    def _add(self, keys: np.ndarray, units: list[str]) -> None:
        flat, sizes = self.encode(units)
        m, n = len(units), self.n
        while n + m > len(self.offset):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], 1)
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.keys[:, n : n + m] = keys
        self.flat[self.used : self.used + len(flat)] = flat
        self.length[n : n + m] = sizes
        self.offset[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n + m, self.used + len(flat)
        todo, slot = np.arange(n, n + m), (keys[0] >> self.shift).astype(np.int64)
        while len(todo):
            free = np.flatnonzero(self.slots[slot] < 0)
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[first]] = todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _distinct(self, keys: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each unit among the spans `new`, and each span's place among those."""
        _, first, back = np.unique(keys[0][new], return_index=True, return_inverse=True)
        if (keys[1][new] != keys[1][new[first]][back]).any():
            raise ValueError("two units share half a key")  # one chance in some 10**7 a table
        return new[first], back

    def _step(self, raw: bytes, eights: np.ndarray, heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        long = lengths > self.WIDEST
        if long.any():
            sizes, parts = np.zeros(len(heads), np.int64), []
            for at in (np.flatnonzero(long), np.flatnonzero(~long)):
                if len(at):
                    got = self.encode(self._decoded(raw, heads[at], lengths[at])) if long[at[0]] else self._step(raw, eights, heads[at], lengths[at])
                    sizes[at] = got[1]
                    parts.append((at, *got))
            out, first = np.empty(int(sizes.sum()), np.int32), np.cumsum(sizes) - sizes
            for at, flat, size in parts:
                out[np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(len(flat))] = flat
            return out, sizes
        keys = self.hashes(eights, heads, lengths)
        at = self.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            one, back = self._distinct(keys, new)
            if self.n + len(one) > self.limit:
                self.clear()
                new = np.arange(len(heads))
                one, back = self._distinct(keys, new)
            n = self.n
            self._add(keys[:, one], self._decoded(raw, heads[one], lengths[one]))
            at[new] = n + back
        size = self.length[at].astype(np.int64)
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.offset[at] - (ends - size), size) + np.arange(ends[-1])], size

    @staticmethod
    def _decoded(raw: bytes, heads: np.ndarray, lengths: np.ndarray) -> list[str]:
        return [raw[a : a + n].decode() for a, n in zip(heads.tolist(), lengths.tolist(), strict=True)]

    def ids(self, raw: bytes, heads: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all spans of `raw`, and each one's number of ids."""
        if not len(heads):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        eights = np.ndarray((len(raw) + 1,), "<u8", raw + bytes(8), strides=(1,))
        step = min(self.STEP, self.limit)
        parts = [self._step(raw, eights, heads[i : i + step], lengths[i : i + step]) for i in range(0, len(heads), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
