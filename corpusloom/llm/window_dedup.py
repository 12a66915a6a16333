"""Substring dedup by compact windows: near-duplicate passages of ``WORDS`` words or more across documents.

A text is the sequence of its ``N``-word shingles.  For each of ``FUNCTIONS`` hash functions the Cartesian tree over
the shingles' hashes groups all passages with one min-hash: a node at position c that is smallest over [l, r] stands
for every passage that holds c and stays inside, its compact window.  Only nodes whose window can hold a passage
count, about 2 / (passage length) of all positions; they are the minima of the sliding windows of that length.

Windows meet by their pivot's hash.  A window travels as its context, the shingles (32 bits of each) of every passage
it stands for and as many on either side as a similar stretch can have; equal contexts travel once from each group of
documents, with the smallest id, and without shingles where all windows of a pivot are alike.  In each pivot's group
the interval join is made on the shingles: a passage counts if the Jaccard similarity of its shingles to a stretch of
``WORDS`` to 1.25 ``WORDS`` words around the same pivot in a document with a smaller id is at least 0.8.

A group's contexts are compared with all earlier ones that share enough shingles, but for pairs whose passages have
their counterparts already and whose contexts are joined by other links.  In a large group they are found by the
rarest shingles of each passage, which any counterpart has one of.  Every link that joins what no others join
is kept, so classes are whole.  An exact repeat of ``WORDS`` words always has a common pivot; two passages at
similarity s have one with a chance of 1 - (1 - s) ** 3, 0.992 at 0.8.

Stretches that repeat shingles are compared by their places first and as sets where these agree; in large groups
those of few different shingles are matched as sets alone.

A pivot of more than ``HOT`` contexts is split: its passages meet by that pivot and one of another function, of
``SPLIT`` in all.  Where every pivot is split, two passages at similarity 0.8 still meet with a chance of 0.988.

Defined cases: a null or empty text, or one of fewer than ``WORDS`` words, has no passage; rows that share an id are
not held against each other; a null id comes after all others; every input row gives one row; a very long text is
worked on as a block of its own; columns other than id and text are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import LOW6, by_key, joined, schema, six, table, unsix, within
from .blocks import SOLID, U, Block, checkpointed, gather, gram_hash, mix, pieces, prefix_sums, reach, span_hash, starts, tidy
from .graph import components

N, WORDS = 5, 50
#: Shingles of a passage, and how many more on either side of a pivot its counterpart may have.
LEAST = WORDS - N + 1
FUNCTIONS = 3
#: Functions by which the passages of a split pivot meet, that pivot's own among them.
SPLIT = 5
SIMILARITY = 0.8
AROUND = int(LEAST / SIMILARITY) - 1
#: Places of a passage whose shingles its counterpart has, at least.
ENOUGH = math.ceil(2 * LEAST * SIMILARITY / (1 + SIMILARITY))
HOT = 1 << 14
BUCKET_BYTES, FLUSH = 8 << 20, 1 << 19
#: Groups of so few contexts are compared at once; larger ones with so many of their first, then by the shingles they share.
SMALL, FIRST = 12, 16
#: Passages of so few distinct shingles are matched as sets in groups of more contexts than ``MANY``.
FEW, MANY = 23, 64
_BATCH = 1 << 14
_PIECE = 1 << 19
_LAST = (1 << 63) - 1
_LOW4 = U((1 << 32) - 1)
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, SPLIT, dtype=U)


def sliding(v: np.ndarray, fold) -> np.ndarray:
    """The least (or largest) of each stretch of ``LEAST`` values."""
    size = 1
    n = len(v) - LEAST + 1
    while 2 * size <= LEAST:
        v = fold(v[:-size], v[size:])
        size *= 2
    return fold(v[:n], v[LEAST - size : LEAST - size + n])


class Windows:
    """The compact windows of a block: pivot hash, row, first shingle, size, and first and last start of their passages.

    Shingles are numbered over the block; starts count from the context's first shingle.
    """

    def __init__(self, texts: pa.Array):
        b = self.block = Block(texts, lower=True)
        b.words(SOLID)
        at, self.shingles = b.grams(b.word_hashes(), N)
        g, row = self.shingles, b.row[at]
        # a 0 before each row's shingles keeps windows inside the row
        place = self.place = np.arange(len(g)) + row + 1
        n = self.width = len(g) + b.rows + 1
        self.least, found = {}, []
        for f in range(FUNCTIONS if n >= LEAST else 0):
            v = self._values(f)
            low = self.least[f] = sliding(v, np.minimum)
            new = np.append(True, low[1:] != low[:-1])
            begin = np.flatnonzero(new & (low > 0))
            view = np.lib.stride_tricks.sliding_window_view(v, LEAST)[begin]
            c = np.unique(begin + (view == low[begin][:, None]).argmax(1))
            left, right = self._reach(v, c)
            r = row[np.searchsorted(place, c)]
            begin = left - 1 - r
            found.append((v[c], np.full(len(c), f), r, begin, right - left + 1, np.maximum(c - left - LEAST + 1, 0), np.minimum(c - left, right - left + 1 - LEAST)))
        none = np.zeros(0, np.int64)
        self.pivot, self.function, self.row, self.begin, self.size, self.first, self.last = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none.astype(U), *(none,) * 6)
        self.sums = prefix_sums(g)

    def _values(self, f: int) -> np.ndarray:
        """The shingles' values by a function, 0 before each row."""
        v = np.zeros(self.width, U)
        v[self.place] = np.maximum(mix(self.shingles ^ _SEEDS[f]), U(1))
        return v

    def _least(self, f: int) -> np.ndarray:
        """The pivot of each passage by a function; those beyond ``FUNCTIONS`` are worked out where a block has split pivots."""
        if f not in self.least:
            self.least[f] = sliding(self._values(f), np.minimum)
        return self.least[f]

    @staticmethod
    def _reach(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far c stays the (leftmost) smallest value, ``AROUND`` at most."""
        own, levels = v[c], [v]
        while 2 << len(levels) <= 2 * AROUND:
            s = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-s], levels[-1][s:]) if len(levels[-1]) > s else levels[-1][:0])
        left, right = c.copy(), c.copy()
        for k in range(len(levels) - 1, -1, -1):
            low, s = levels[k], 1 << k
            if not len(low):
                continue
            fits = (left - s >= 0) & (low[np.maximum(left - s, 0)] > own)
            left = np.where(fits, left - s, left)
            fits = (right + s < len(v)) & (low[np.minimum(right + 1, len(low) - 1)] >= own)
            right = np.where(fits, right + s, right)
        return np.maximum(left, c - AROUND), np.minimum(right, c + AROUND)

    def keys(self) -> np.ndarray:
        """One number for each context and pivot."""
        return mix(span_hash(self.sums, self.begin, self.begin + self.size) ^ self.pivot)

    def split(self, hot: np.ndarray) -> None:
        """Windows of hot pivots become one for each pivot of another function that their passages have."""
        old = within(self.pivot & LOW6, hot)
        if not old.any():
            return
        at, fields = np.flatnonzero(old), ("pivot", "function", "row", "begin", "size", "first", "last")
        parts = [tuple(getattr(self, x)[~old] for x in fields)]
        for f in range(SPLIT):
            k = at[self.function[at] != f]
            count = self.last[k] - self.first[k] + 1
            k = np.repeat(k, count)
            start = self.first[k] + np.arange(len(k)) - np.repeat(starts(count)[:-1], count)
            low = self._least(f)[self.begin[k] + 1 + self.row[k] + start]
            new = np.append(True, (np.diff(k) > 0) | (low[1:] != low[:-1]))[: len(k)]
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(k))[: len(head)] - 1
            k = k[head]
            parts.append((mix(self.pivot[k] ^ (low[head] * U(0x9E3779B97F4A7C15))), np.full(len(k), -1), self.row[k], self.begin[k], self.size[k], start[head], start[tail]))
        for x, own in zip(fields, zip(*parts, strict=True), strict=True):
            setattr(self, x, np.concatenate(own))


def before(a: np.ndarray) -> np.ndarray:
    """The place of the same value before each place, -1 for none."""
    order = np.argsort(a, kind="stable")
    out = np.full(len(a), -1)
    same = a[order][1:] == a[order][:-1]
    out[order[1:][same]] = order[:-1][same]
    return out


def distinct(last: np.ndarray, size: int, counted: np.ndarray | None = None) -> np.ndarray:
    """How many distinct values (of the counted places) each stretch of ``size`` has; ``last`` from ``before``."""
    at = np.arange(len(last)) if counted is None else np.flatnonzero(counted)
    n = len(last) + 1
    change = np.bincount(np.maximum(last[at], at - size) + 1, minlength=n) - np.bincount(at + 1, minlength=n)
    return np.cumsum(change[:-1])[: max(len(last) - size + 1, 0)]


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each passage of ``a`` is similar enough to a stretch of ``LEAST`` shingles or up to a quarter more of ``b``, as sets."""
    good = np.zeros(max(len(a) - LEAST + 1, 0), bool)
    if len(a) < LEAST or len(b) < LEAST:
        return good
    # the same words in the same order need no sets
    good[:] = within(gram_hash(a.astype(U), LEAST), np.unique(gram_hash(b.astype(U), LEAST)))
    own = distinct(before(a), LEAST)
    rest = np.flatnonzero(~good & (distinct(before(a), LEAST, within(a, np.unique(b))) >= SIMILARITY * own))
    if not len(rest):
        return good
    # counted[i, p]: place p of b has a shingle of passage i; inside[p, x]: it is the first such place of stretch x
    hits = np.cumsum(np.concatenate([np.zeros((1, len(b)), np.int16), a[:, None] == b]), axis=0, dtype=np.int16)
    counted = (hits[rest + LEAST] > hits[rest]).astype(np.float32)
    size = np.arange(LEAST, min(LEAST + LEAST // 4, len(b)) + 1)
    begin = np.arange(len(b) - LEAST + 1)
    begin, size = np.repeat(begin, len(size)), np.tile(size, len(begin))
    fits = begin + size <= len(b)
    begin, size = begin[fits], size[fits]
    place = np.arange(len(b))[:, None]
    inside = ((place >= begin) & (place < begin + size) & (before(b)[:, None] < begin)).astype(np.float32)
    both = counted @ inside
    good[rest] = (both >= SIMILARITY * (own[rest][:, None] + inside.sum(0) - both) - 1e-4).any(1)
    return good


class Sets:
    """The sets of shingles that the contexts of a large group have on their stretches, where these are of few shingles, and which are similar.

    A passage that repeats a few shingles lies in the shingles of nearly every context of its pivot and is similar to
    few of them.  Sets of ``FEW`` shingles are compared by their rarest ones: sets of m and n shingles are similar only
    if they share one of the m - 0.8 m + 1 rarest of the one and as many of the other, and m and n are alike.
    """

    def __init__(self, data: np.ndarray, size: np.ndarray, asks: np.ndarray):
        """``asks``: the places at which a passage begins that is to be compared."""
        off, n = starts(size)[:-1], len(size)
        context = np.repeat(np.arange(n), size)
        values, shingle = np.unique(data, return_inverse=True)
        spread = np.bincount(np.unique(shingle * np.int64(n) + context) // n, minlength=len(values))
        rarity = np.empty(len(values), np.int64)
        rarity[np.argsort(spread, kind="stable")] = np.arange(len(values))
        self.rank = rarity[shingle]
        # sets are told apart by the sum of their shingles' hashes
        value, last, at = mix(self.rank.astype(U) + U(1)), before(context * np.int64(len(values)) + self.rank), np.arange(len(data))
        found = []
        for length in range(LEAST, LEAST + LEAST // 4 + 1):
            enter, change, sums = np.maximum(last, at - length) + 1, np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, U)
            np.add.at(change, enter, 1)
            np.add.at(sums, enter, value)
            change[1:] -= 1
            sums[1:] -= value
            count, sums = np.cumsum(change), np.cumsum(sums)
            begin = gather(at, off, np.maximum(size - length + 1, 0))
            begin = begin[count[begin] <= FEW * 5 // 4]
            new = np.append(True, (np.diff(begin) > 1) | (np.diff(context[begin]) > 0) | (sums[begin][1:] != sums[begin][:-1]))[: len(begin)]
            if length == LEAST:
                passage = begin[asks[begin] & (count[begin] <= FEW)]
                mine = sums[passage]
            begin = begin[new]
            found.append((sums[begin], context[begin], begin, np.full(len(begin), length), count[begin]))
        sums, holder, begin, length, count = (np.concatenate(x) for x in zip(*found, strict=True))
        key, one, which = np.unique(sums, return_index=True, return_inverse=True)
        begin, length, self.count = begin[one], length[one], count[one]
        pair = np.unique(which * np.int64(n) + holder)
        #: Contexts of each set, and sets of each context; the set of each passage of few shingles, -1 for others.
        self.holders, self.held_by = pair % n, np.searchsorted(pair // n, np.arange(len(key) + 1))
        turned = np.argsort(self.holders, kind="stable")
        self.held, self.holds = (pair // n)[turned], np.searchsorted(self.holders[turned], np.arange(n + 1))
        self.own = np.full(len(data), -1)
        self.own[passage] = np.searchsorted(key, mine)
        self._join(begin, length)

    def _join(self, begin: np.ndarray, length: np.ndarray) -> None:
        """Similar sets of each set that a passage asks for."""
        members, sizes = [], self.count
        # the rank after all others pads the stretches
        padded, none = np.append(self.rank, np.full(LEAST + LEAST // 4, len(self.rank))), len(self.rank)
        for i in range(0, len(begin), 1 << 15):
            own = np.lib.stride_tricks.sliding_window_view(padded, LEAST + LEAST // 4)[begin[i : i + (1 << 15)]].copy()
            own[np.arange(own.shape[1]) >= length[i : i + (1 << 15), None]] = none
            own.sort(axis=1)
            new = own < none
            new[:, 1:] &= own[:, 1:] != own[:, :-1]
            members.append(own[new])
        members, cut = np.concatenate(members) if members else self.rank[:0], starts(sizes)
        rare = sizes - (4 * sizes + 4) // 5 + 1
        token, holder = gather(members, cut[:-1], rare), np.repeat(np.arange(len(sizes)), rare)
        order = np.argsort(token, kind="stable")
        token, holder = token[order], holder[order]
        left, right = [], []
        asked = np.unique(self.own[self.own >= 0])
        for i in range(0, len(asked), 1 << 10):
            own = asked[i : i + (1 << 10)]
            ask, of = gather(members, cut[own], rare[own]), np.repeat(own, rare[own])
            lo, hi = np.searchsorted(token, ask), np.searchsorted(token, ask, "right")
            for a in np.split(np.arange(len(ask)), np.unique(np.searchsorted(np.cumsum(hi - lo), np.arange(1 << 20, (hi - lo).sum() + 1, 1 << 20)))):
                x, y = np.repeat(of[a], (hi - lo)[a]), gather(holder, lo[a], (hi - lo)[a])
                use = 5 * np.minimum(sizes[x], sizes[y]) >= 4 * np.maximum(sizes[x], sizes[y])
                pair = np.unique(x[use] * np.int64(len(sizes)) + y[use])
                x, y = pair // len(sizes), pair % len(sizes)
                for j in range(0, len(x), 1 << 15):
                    p, q = x[j : j + (1 << 15)], y[j : j + (1 << 15)]
                    base = np.arange(len(p)) * np.int64(none + 1)
                    one, two = (np.repeat(base, sizes[z]) + gather(members, cut[z], sizes[z]) for z in (p, q))
                    # both are sorted
                    both = np.bincount(np.repeat(np.arange(len(p)), sizes[p])[within(one, two)], minlength=len(p))
                    good = 5 * both >= 4 * (sizes[p] + sizes[q] - both)
                    left.append(p[good])
                    right.append(q[good])
        pair = np.unique(np.concatenate(left) * np.int64(len(sizes)) + np.concatenate(right)) if left else cut[:0]
        self.like, self.liked = pair % max(len(sizes), 1), np.searchsorted(pair // max(len(sizes), 1), np.arange(len(sizes) + 1))

    def like_one(self, h: int) -> np.ndarray:
        """Which passages are similar to a stretch of context ``h``."""
        has = np.zeros(len(self.count), np.int64)
        has[self.held[self.holds[h] : self.holds[h + 1]]] = 1
        near = starts(has[self.like])
        return np.append(np.diff(near[self.liked]) > 0, False)[self.own]

    def like_any(self, begin: int, end: int, n: int) -> np.ndarray:
        """Whether each passage (rows) is similar to a stretch of each context."""
        own, which = np.unique(self.own[begin:end], return_inverse=True)
        out = np.zeros((len(own), n), bool)
        for k in np.flatnonzero(own >= 0).tolist():
            like = self.like[self.liked[own[k]] : self.liked[own[k] + 1]]
            out[k, gather(self.holders, self.held_by[like], self.held_by[like + 1] - self.held_by[like])] = True
        return out[which]


class Contexts:
    """Distinct contexts of some pivots: ``data`` between ``off``, group (pivot), smallest id, first and last start of passages."""

    def __init__(self, group: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray, data: np.ndarray):
        self.group, self.doc, self.first, self.last, self.size, self.data = group, doc, first, last, size, data
        self.off = starts(size)
        #: alive[off[k] + s]: the passage at start s of context k may have a counterpart and has none yet.
        self.alive, self.repeats, self.offers = self._alive()
        #: Passages of few shingles, of contexts in large groups.
        self.few = np.zeros(len(data) + 1, bool)
        self.found: list[tuple[np.ndarray, ...]] = []

    def _alive(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passages that share enough shingles with other contexts of their group; each context's repeated shingles; contexts that share as many."""
        context = np.repeat(np.arange(len(self.size)), self.size)
        group = np.unique(self.group, return_inverse=True)[1]
        key = (group[context].astype(U) << U(32)) | self.data
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(key)]
        head = np.flatnonzero(new)
        if not len(head):
            return np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, bool)
        lone = np.maximum.reduceat(context[order], head) == context[order][head]
        known = np.empty(len(key), bool)
        known[order] = ~lone[np.cumsum(new) - 1]
        # a stable sort leaves the places of one context side by side
        again = ~new & (np.append(-1, context[order][:-1]) == context[order])
        repeats = np.bincount(context[order[again]], minlength=len(self.size))
        count = starts(known)
        alive = np.zeros(len(key) + 1, bool)
        n = self.last - self.first + 1
        at = gather(np.arange(len(key)), self.off[:-1] + self.first, n)
        alive[at] = count[at + LEAST] - count[at] >= ENOUGH
        # a counterpart's matches may lie on fewer places
        return alive, repeats, np.diff(count[self.off]) >= np.where(repeats > 0, 1, ENOUGH)

    def similar(self, a: np.ndarray, b: np.ndarray, still: np.ndarray, near: np.ndarray | None = None) -> np.ndarray:
        """Whether each passage of the contexts a (one after the other) is similar enough to a stretch of the context in b.

        Where ``still`` holds only passages without a counterpart count.  ``near``: whether passages of few shingles are.
        """
        size, other = self.size[a], self.size[b]
        pair, with_ = np.repeat(np.arange(len(a)), size), np.repeat(np.arange(len(b)), other)
        x = (pair.astype(U) << U(32)) | gather(self.data, self.off[a], size)
        y = (with_.astype(U) << U(32)) | gather(self.data, self.off[b], other)
        order = np.argsort(y)
        at = np.minimum(np.searchsorted(y[order], x), len(y) - 1)
        hit = y[order][at] == x
        place = order[at]
        n = len(x) - LEAST + 1
        low, high = sliding(np.where(hit, place, len(y)), np.minimum), sliding(np.where(hit, place, -1), np.maximum)
        # distinct shingles of each passage, and those of them that the other context has
        last = np.full(len(x), -1)
        if self.repeats[a].any():
            last = before(x)
        own, both = distinct(last, LEAST), distinct(last, LEAST, hit)
        good = np.zeros(len(x), bool)
        # the counterpart is the stretch that holds all matches
        good[:n] = both >= SIMILARITY * (LEAST + np.maximum(high - low + 1, LEAST) - both)
        good &= np.repeat(self.repeats[a] + self.repeats[b] == 0, size)
        cut = starts(size)
        allowed = np.zeros(len(x), bool)
        allowed[gather(np.arange(len(x)), cut[:-1] + self.first[a], self.last[a] - self.first[a] + 1)] = True
        allowed &= ~np.repeat(still, size) | self.alive[np.repeat(self.off[a] - cut[:-1], size) + np.arange(len(x))]
        good &= allowed
        # repeated shingles and matches far off need a closer look
        hopeful = np.zeros(len(x), bool)
        # (with repeats on either side: by their places first, as sets only if these agree)
        count = starts(hit)
        places = count[LEAST:] - count[:n]
        alike = (places >= SIMILARITY * (LEAST + np.maximum(high - low + 1, LEAST) - places)) & (both >= SIMILARITY * own)
        hopeful[:n] = np.where(np.repeat(self.repeats[a] + self.repeats[b] > 0, size)[:n], alike, both >= ENOUGH)
        if near is not None:
            few = self.few[np.repeat(self.off[a] - cut[:-1], size) + np.arange(len(x))]
            good, hopeful = np.where(few, near & allowed, good), hopeful & ~few
        unsure = hopeful & allowed & ~good
        rest = np.flatnonzero(np.bincount(pair, unsure, len(a)) > 0)
        for k in rest:
            mine, against = (self.data[self.off[z[k]] : self.off[z[k] + 1]] for z in (a, b))
            i, j = self.first[a[k]], self.last[a[k]] + 1
            need = np.flatnonzero(unsure[cut[k] + i : cut[k] + j]) + i
            if len(need):
                i, j = need[0], need[-1] + 1
                good[cut[k] + i : cut[k] + j] |= verified(mine[i : j + LEAST - 1], against) & allowed[cut[k] + i : cut[k] + j]
        return good

    def compare(self, a: np.ndarray, b: np.ndarray, joined_: np.ndarray | None = None, near: np.ndarray | None = None) -> np.ndarray:
        """Notes what each pair has in common and closes passages; whether the pairs are linked.

        Of pairs ``joined_`` by other links only passages that are still open count.
        """
        linked, places = np.zeros(len(a), bool), starts(self.size[a])
        for i in range(0, len(a), _BATCH):
            x, y = a[i : i + _BATCH], b[i : i + _BATCH]
            good = self.similar(x, y, np.zeros(len(x), bool) if joined_ is None else joined_[i : i + _BATCH], None if near is None else near[places[i] : places[i + len(x)]])
            size = self.size[x]
            pair, cut = np.repeat(np.arange(len(x)), size), starts(size)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
            head, tail = edge[::2], edge[1::2] - 1
            k = pair[head] if len(head) else head
            self.found.append((x[k], self.doc[y[k]], head - cut[k], tail - cut[k]))
            linked[i + k] = True
            closed = np.flatnonzero(good)
            self.alive[self.off[x[pair[closed]]] + closed - cut[pair[closed]]] = False
        return linked

    def link(self) -> tuple[np.ndarray, ...]:
        """(context, id of an earlier document, first and last start of passages with a counterpart there)."""
        ever = np.flatnonzero(self.offers)
        ever = ever[np.lexsort((self.doc[ever], self.group[ever]))]
        none = np.zeros(0, np.int64)
        for own, many in self._sized(ever):
            if not many:
                self.compare(*own)
            else:
                self._large(own)
        return tuple(np.concatenate(x) for x in zip(*self.found, strict=True)) if self.found else (none,) * 4

    def _sized(self, ever: np.ndarray) -> Iterator[tuple]:
        """All pairs of the small groups at once, then each large group."""
        if not len(ever):
            return
        head = np.flatnonzero(np.append(True, np.diff(np.unique(self.group[ever], return_inverse=True)[1]) != 0))
        count = np.diff(np.append(head, len(ever)))
        rank = np.arange(len(ever)) - np.repeat(head, count)
        few = np.repeat(count <= SMALL, count)
        later = np.repeat(np.flatnonzero(few), rank[few])
        earlier = later - rank[later] + np.arange(len(later)) - np.repeat(starts(rank[few])[:-1], rank[few])
        a, b = ever[later], ever[earlier]
        asks = np.logical_or.reduceat(self.alive, self.off[:-1])
        use = (self.doc[b] < self.doc[a]) & asks[a]
        yield (a[use], b[use]), False
        for i, n in zip(head[count > SMALL], count[count > SMALL], strict=True):
            yield ever[i : i + n], True

    def _open(self, own: np.ndarray) -> np.ndarray:
        return np.array([self.alive[self.off[k] : self.off[k + 1]].any() for k in own.tolist()], bool)

    @staticmethod
    def _places(data: np.ndarray, cut: np.ndarray, others: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(other context, place of ``a``) where the other context has that place's shingle."""
        values, which = np.unique(a, return_inverse=True)
        found, size = gather(data, cut[others], cut[others + 1] - cut[others]), cut[others + 1] - cut[others]
        at = np.minimum(np.searchsorted(values, found), len(values) - 1)
        hit = np.zeros((len(others), len(values)), bool)
        hit[np.repeat(np.arange(len(others)), size)[values[at] == found], at[values[at] == found]] = True
        j, q = np.nonzero(hit[:, which])
        return others[j], q

    def _large(self, own: np.ndarray) -> None:
        """A group in order of its ids: against its first contexts, then against all that may still matter."""
        n, label, asks = len(own), np.arange(len(own)), self._open(own)

        def join(later: np.ndarray, earlier: np.ndarray, near: np.ndarray | None) -> None:
            use = self.doc[own[earlier]] < self.doc[own[later]]
            if near is not None:
                near = near[np.repeat(use, size[later])]
            later, earlier = later[use], earlier[use]
            done = self.compare(own[later], own[earlier], label[later] == label[earlier], near)
            for x, y in zip(later[done].tolist(), earlier[done].tolist(), strict=True):
                if label[x] != label[y]:
                    label[label == max(label[x], label[y])] = min(label[x], label[y])

        at, size = np.flatnonzero(asks), self.size[own]
        places = gather(np.arange(len(self.data)), self.off[own], size)
        every, cut, sets = self.data[places], starts(size), None
        if n > MANY and self.repeats[own].any():
            passage = np.zeros(len(every), bool)
            passage[gather(np.arange(len(every)), cut[at] + self.first[own[at]], (self.last - self.first + 1)[own[at]])] = True
            sets = Sets(every, size, passage)
            self.few[places] = sets.own >= 0
            # contexts that ask for passages of more shingles are not told by their sets
            plain = np.logical_or.reduceat(self.alive[places] & (sets.own < 0), cut[:-1])
        for h in range(min(FIRST, n)):
            rest, near = at[at > h], None
            rest = rest[self._open(own[rest]) | (label[rest] != label[h])]
            if sets:
                near = sets.like_one(h)
                use = np.logical_or.reduceat(near & (self.alive[places] | np.repeat(label != label[h], size)), cut[:-1])
                rest = rest[(plain | use)[rest]]
                near = gather(near, cut[rest], size[rest])
            if len(rest):
                join(rest, np.full(len(rest), h), near)
        shingle, has = every, np.repeat(np.arange(n), size)
        order = np.lexsort((has, shingle))
        shingle, has = shingle[order], has[order]
        new = np.append(True, (shingle[1:] != shingle[:-1]) | (has[1:] != has[:-1]))
        shingle, has = shingle[new], has[new]
        for k in at[at > FIRST].tolist():
            base = self.off[own[k]]
            alive = self.alive[base : base + size[k]]
            apart = label[:k] != label[k]
            if not alive.any() and not apart.any():
                continue
            a = self.data[base : base + size[k]]
            i, m, use = self.first[own[k]], self.last[own[k]] + 1, np.zeros(k, bool)
            rows, near = np.ones(m - i, bool), None
            if sets:
                near = sets.like_any(cut[k], cut[k + 1], n)
                use |= near[:, :k][alive].any(0) | (near[:, :k].any(0) & apart)
                rows = sets.own[cut[k] + i : cut[k] + m] < 0
            if rows.any():
                # whoever has enough places of a passage has one of those whose shingles the fewest contexts have
                lo, hi = np.searchsorted(shingle, a), np.searchsorted(shingle, a, "right")
                rare = np.argpartition(np.lib.stride_tricks.sliding_window_view(hi - lo, LEAST)[i:m][rows], LEAST - ENOUGH, axis=1)[:, : LEAST - ENOUGH + 1] + np.flatnonzero(rows)[:, None] + i
                for of, among in ((rare[alive[i:m][rows]], None), (rare, apart)):
                    spots = np.unique(of)
                    if among is None or among.any():
                        j = gather(has, lo[spots], (hi - lo)[spots])
                        j = j[j < k]
                        use[j if among is None else j[among[j]]] = True
            use[:FIRST] = False
            j, q = self._places(every, cut, np.flatnonzero(use), a)
            some, j = np.unique(j, return_inverse=True)
            if not len(some):
                continue
            hits = np.zeros((size[k] + 1, len(some)), np.int16)
            hits[q + 1, j] = 1
            hits = np.cumsum(hits, axis=0, dtype=np.int16)
            shared = hits[i + LEAST : m + LEAST] - hits[i:m]
            enough = shared >= ENOUGH
            if sets:
                enough = np.where(sets.own[cut[k] + i : cut[k] + m, None] >= 0, near[i:m, some], enough)
            rest = np.argsort(-shared.max(0), kind="stable")
            while True:
                # what may close an open passage or join another class
                use = enough[alive[i:m]].any(0)[rest] | (enough.any(0)[rest] & (label[some[rest]] != label[k]))
                rest = rest[use]
                if not len(rest):
                    break
                now, rest = some[rest[:FIRST]], rest[FIRST:]
                join(np.full(len(now), k), now, near[:, now].T.ravel() if sets else None)


_LONG, _BIN, _INT = T.LongType(), T.BinaryType(), T.IntegerType()
_SEEN = schema(bucket=_LONG, homes=_BIN, counts=_BIN, pivot=_BIN, key=_BIN, many=_BIN)
_SHARED = schema(home=_LONG, alike=_BIN, unlike=_BIN, hot=_BIN)
_CONTEXT = schema(bucket=_LONG, home=_LONG, pivot=_BIN, key=_BIN, doc=_BIN, others=_BIN, first=_BIN, last=_BIN, size=_BIN, data=_BIN)
_ANSWER = schema(home=_LONG, hot=_BIN, key=_BIN, owner=_BIN, first=_BIN, last=_BIN)
_SPAN = T.ArrayType(schema(start=_INT, end=_INT))
_OUT = schema(doc=_LONG, n_words=_LONG, spans=_SPAN, sources=T.ArrayType(_LONG))


def _four(x: np.ndarray) -> np.ndarray:
    return (x & _LOW4).astype(np.uint32)


def _windows(t: pa.Table) -> Iterator[tuple[Windows, np.ndarray]]:
    doc, texts = t.column("doc").combine_chunks(), t.column("text").combine_chunks()
    for i, j in pieces(texts, _PIECE):
        yield Windows(texts.slice(i, j - i)), doc.slice(i, j - i).to_numpy()


def seen_rows(pivot: np.ndarray, key: np.ndarray, home: np.ndarray, buckets: int) -> list[tuple]:
    """A row for each bucket, in which the homes lie one after the other: rows of a task don't grow with buckets times homes."""
    to, rows = (pivot % U(buckets)).astype(np.int64), []
    order = np.lexsort((key, pivot, home, to))
    pivot, key, home, to = pivot[order], key[order], home[order], to[order]
    head = np.flatnonzero(np.append(True, (np.diff(to) != 0) | (np.diff(home) != 0) | (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1])))
    many = np.diff(np.append(head, len(order))) > 1
    pivot, key, home, to = pivot[head], key[head], home[head], to[head]
    first = np.flatnonzero(np.append(True, (np.diff(to) != 0) | (np.diff(home) != 0)))
    count, cut = np.diff(np.append(first, len(to))).astype(np.int32), np.flatnonzero(np.append(True, np.diff(to) != 0))
    runs = np.searchsorted(first, np.append(cut, len(to)))
    for k, (i, j) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True)):
        r = slice(runs[k], runs[k + 1])
        rows.append((int(to[i]), home[first[r]].astype(np.int32).tobytes(), count[r].tobytes(), six(pivot[i:j]), key[i:j].tobytes(), np.packbits(many[i:j]).tobytes()))
    return rows


def sort_pivots(pivot: np.ndarray, key: np.ndarray, times: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pivots that two rows have: those whose contexts are all alike, those whose contexts differ, and those of more than ``hot`` contexts."""
    own, which = np.unique(pivot, return_inverse=True)
    if not len(own):
        return own, own, own
    order = np.argsort(which, kind="stable")
    head = np.flatnonzero(np.append(True, np.diff(which[order]) > 0))
    rows = np.add.reduceat(times[order].astype(np.int64), head)
    alike = np.minimum.reduceat(key[order], head) == np.maximum.reduceat(key[order], head)
    contexts = np.diff(np.append(head, len(order)))
    shared = rows > 1
    return own[shared & alike], own[shared & ~alike & (contexts <= hot)], own[shared & ~alike & (contexts > hot)]


def passages(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """doc, n_words, spans (word ranges of passages that nearly repeat an earlier document) and sources (those documents) of each row."""
    reach(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, math.ceil(size / BUCKET_BYTES))
    # neighbouring ids share a home, so that a task's blobs go to few; rows without an id are dealt by their text
    home = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64(F.shiftright("id", 6))), F.lit(buckets))
    source = source.select(F.coalesce("id", F.lit(_LAST)).alias("doc"), "text", home.alias("home"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            pivot, key, home = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = seen_rows(pivot, key, home, buckets)
            held.clear()
            return table(_SEEN, rows).combine_chunks().to_batches()[0]

        for batch in batches:
            home = batch.column("home").to_numpy()
            for i, j in pieces(batch.column("text"), _PIECE):
                w = Windows(batch.column("text").slice(i, j - i))
                if len(w.pivot):
                    # a row counts once for each pivot and context
                    pivot, key = w.pivot & LOW6, _four(w.keys())
                    order = np.lexsort((key, pivot, w.row))
                    pivot, key, row = pivot[order], key[order], w.row[order]
                    new = np.append(True, (np.diff(row) > 0) | (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1]))
                    held.append((w.pivot[order][new], key[new], home[i:j][row[new]]))
                    count += len(held[-1][0])
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()
        tidy()

    def shared(t: pa.Table) -> pa.Table:
        pivots = [unsix(x) for x in t.column("pivot").to_pylist()]
        times = [1 + np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(t.column("many").to_pylist(), pivots, strict=True)]
        kinds = sort_pivots(np.concatenate(pivots), joined(t, "key", np.uint32), np.concatenate(times), hot)
        pivot, home = np.concatenate(pivots), np.repeat(joined(t, "homes", np.int32), joined(t, "counts", np.int32))
        order = np.lexsort((pivot, home))
        pivot, home = pivot[order], home[order]
        new = np.append(True, (np.diff(home) != 0) | (pivot[1:] != pivot[:-1]))[: len(pivot)]
        pivot, home = pivot[new], home[new]
        homes, rows = np.unique(home), []
        parts = [(own := within(pivot, kind), np.searchsorted(home[own], homes, "right")) for kind in kinds]
        blobs = [(six(pivot[own]), 6 * np.append(0, end)) for own, end in parts]
        for k, h in enumerate(homes.tolist()):
            rows.append((h, *(x[cut[k] : cut[k + 1]] for x, cut in blobs)))
        return table(_SHARED, [x for x in rows if any(x[1:])])

    def contexts(texts: pa.Table, marks: pa.Table) -> pa.Table:
        """The windows of shared pivots, equal ones once with the smallest id of this home."""
        tidy()
        if not texts.num_rows or not marks.num_rows:
            return table(_CONTEXT, [])
        alike, unlike, busy = (np.unique(unsix(b"".join(marks.column(c).to_pylist()))) for c in ("alike", "unlike", "hot"))
        parts, grams, base = [], [], 0
        for w, doc in _windows(texts):
            w.split(busy)
            low = w.pivot & LOW6
            # the parts of hot pivots are always compared
            plain = within(low, alike)
            k = np.flatnonzero(plain | within(low, unlike) | (w.function < 0))
            parts.append((w.pivot[k], w.keys()[k], doc[w.row[k]], w.first[k], w.last[k], np.where(plain[k], 0, w.size[k]), w.begin[k] + base))
            grams.append(_four(w.shingles))
            base += len(w.shingles)
        pivot, key, doc, first, last, size, begin = (np.concatenate(x) for x in zip(*parts, strict=True))
        data, home, rows = np.concatenate(grams), texts.column("home")[0].as_py(), []
        order = np.lexsort((doc, key))
        head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(order)])
        others = doc[order[np.append(head[1:], len(order)) - 1]] > doc[order[head]] if len(head) else np.zeros(0, bool)
        at = order[head]
        to = (pivot[at] % U(buckets)).astype(np.int64)
        for own in by_key(to):
            i = at[own]
            rows.append((int(to[own[0]]), home, pivot[i].tobytes(), key[i].tobytes(), doc[i].tobytes(), others[own].tobytes(), *(x[i].astype(np.uint8).tobytes() for x in (first, last, size)), gather(data, begin[i], size[i]).tobytes()))
        return table(_CONTEXT, rows)

    def answers(t: pa.Table) -> pa.Table:
        """For each home and context: ids of earlier documents and the passages that have a counterpart there."""
        tidy()
        pivot, key, doc, data = joined(t, "pivot", U), joined(t, "key", U), joined(t, "doc", np.int64), joined(t, "data", np.uint32)
        first, last, size = (joined(t, c, np.uint8).astype(np.int64) for c in ("first", "last", "size"))
        home = np.repeat(t.column("home").to_numpy(), [len(x) // 8 for x in t.column("key").to_pylist()])
        order = np.lexsort((doc, key))
        new = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
        one, which = order[new], np.zeros(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        unlike = np.flatnonzero(size[one] > 0)
        own = one[unlike]
        x = Contexts(pivot[own], doc[own], first[own], last[own], size[own], gather(data, starts(size)[:-1][own], size[own]))
        k, owner, i, j = x.link()
        # equal contexts: the smallest id has all of their passages
        k, owner, i, j = (np.concatenate(z) for z in ((np.arange(len(one)), unlike[k]), (doc[one], owner), (first[one], i), (last[one], j)))
        order = np.argsort(k, kind="stable")
        owner, i, j, count = owner[order], i[order], j[order], np.bincount(k, minlength=len(one))
        useful, rows = np.flatnonzero(joined(t, "others", bool) | (count[which] > 1) | (doc > doc[one][which])), []
        for at in by_key(home[useful]):
            at = useful[at]
            e = gather(np.arange(len(owner)), starts(count)[:-1][which[at]], count[which[at]])
            rows.append((int(home[at[0]]), b"", np.repeat(key[at], count[which[at]]).tobytes(), owner[e].tobytes(), i[e].astype(np.uint8).tobytes(), j[e].astype(np.uint8).tobytes()))
        return table(_ANSWER, rows)

    def judge(texts: pa.Table, found: pa.Table) -> pa.Table:
        tidy()
        if not texts.num_rows:
            return table(_OUT, [])
        key, owner, first, last = joined(found, "key", U), joined(found, "owner", np.int64), joined(found, "first", np.uint8).astype(np.int64), joined(found, "last", np.uint8).astype(np.int64)
        busy = np.unique(unsix(b"".join(found.column("hot").to_pylist())))
        order = np.argsort(key, kind="stable")
        key, owner, first, last = key[order], owner[order], first[order], last[order]
        rows = []
        for w, doc in _windows(texts):
            w.split(busy)
            b, own = w.block, w.keys()
            lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
            k = np.repeat(np.arange(len(own)), hi - lo)
            e = gather(np.arange(len(key)), lo, hi - lo)
            use = owner[e] < doc[w.row[k]]
            k, e = k[use], e[use]
            row = w.row[k]
            # the first word of a shingle: a row has N - 1 words more than shingles, if it has any
            shingles = np.maximum(np.diff(b.first) - N + 1, 0)
            word = w.begin[k] - starts(shingles)[row] + b.first[row]
            change = np.bincount(word + first[e], minlength=len(b.start) + 1) - np.bincount(word + last[e] + WORDS, minlength=len(b.start) + 1)
            cover = np.cumsum(change)[:-1] > 0
            pairs = np.unique(np.column_stack([row, owner[e]]), axis=0)
            cut = np.searchsorted(pairs[:, 0], np.arange(b.rows + 1))
            for r in range(b.rows):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], cover[b.first[r] : b.first[r + 1]], [False]]).astype(np.int8))).reshape(-1, 2)
                rows.append((int(doc[r]), int(b.first[r + 1] - b.first[r]), [{"start": int(p), "end": int(q)} for p, q in edge], pairs[cut[r] : cut[r + 1], 1].tolist()))
        return table(_OUT, rows)

    marks = source.mapInArrow(seen, _SEEN).groupBy("bucket").applyInArrow(shared, _SHARED)
    # the texts are dealt once; both visits read the same exchange
    dealt = source.select("doc", "text", "home").groupBy("home")
    found = dealt.cogroup(marks.groupBy("home")).applyInArrow(contexts, _CONTEXT).groupBy("bucket").applyInArrow(answers, _ANSWER)
    none = F.lit(b"")
    busy = marks.where(F.length("hot") > 0).select("home", "hot", *(none.alias(c) for c in ("key", "owner", "first", "last")))
    return dealt.cogroup(found.unionByName(busy).groupBy("home")).applyInArrow(judge, _OUT)


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``passages`` with class, the smallest id that a document reaches over shared passages."""
    found = checkpointed(passages(docs, text, doc_id))
    roots = components(found.select("doc", F.explode("sources").alias("b")).select(F.col("doc").alias("a"), "b"))
    return found.join(roots.withColumnRenamed("u", "doc"), "doc", "left").withColumn("class", F.coalesce("root", "doc")).drop("root")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its class, the earlier documents it repeats passages of, and how many words those have."""
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(F.col("doc").alias("doc_id"), F.col("class").alias("class_id"), "n_words", covered.alias("n_repeated_words"), F.size("spans").cast("long").alias("n_passages"), F.size("sources").cast("long").alias("n_links"), F.col("sources").alias("source_ids"))
