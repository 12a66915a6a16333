"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

The suffixes are sorted by the difference-cover method: the triples at positions 1 and 2 modulo 3 are sorted and
named, the string of names is sorted by recursion, the suffixes at positions 0 modulo 3 are merged in, and
neighbours in the order are compared over ``LENGTH`` bytes.  As no more than ``LENGTH`` bytes matter, the recursion
ends when a name stands for that many.

It is distributed by content.  In every ``LENGTH`` bytes the gram of ``GRAM`` bytes with the smallest hash is its
anchor, so equal strings have equal anchors.  Anchors are counted over documents first; only the stretches around
anchors that two documents share (an anchor's context) travel, each once however often it occurs.  All contexts of an
anchor meet in one task and are sorted there in pieces of ``CHUNK`` bytes or so, but for an anchor with one context,
whose strings have no other place; an anchor's contexts that are far more are split into strings by hash.  Strings
that have no other place by their hash are not sorted.  Places are counted by the homes, and an anchor of more than
``HOT`` of them sends its strings of ``LENGTH`` bytes one by one instead of its context, dealt by their own hash.
Anchors, contexts and answers travel in binary blobs, several hundred to a row.

Anchors and contexts are found by 64-bit hashes; strings are compared byte by byte.

Defined cases: a null text counts as empty; texts under ``LENGTH`` bytes lose nothing; matches never cross
documents; rows that share an id take nothing from each other; a null id comes after all others; every input row
gives one row; columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BYTE, U, Block, gather, inverse_powers, mix, pieces, prefix_sums, reach, span_hash, starts, tidy

LENGTH, GRAM = 50, 20
HOT = 1 << 16
CHUNK = 1 << 18
#: Text of one task's documents, and anchors gathered before a task writes its blobs.
BUCKET_BYTES, FLUSH = 8 << 20, 1 << 19
_LAST = (1 << 63) - 1
_PIECE = 1 << 18
_LOW6 = U((1 << 48) - 1)


def rolling(sums: np.ndarray) -> np.ndarray:
    """Hashes of all grams, in place: any order that all texts share will do."""
    g = sums[GRAM:] - sums[:-GRAM]
    g *= inverse_powers(len(g))
    g ^= g >> U(32)
    g *= U(0xD6E8FEB86659FD93)
    g ^= g >> U(29)
    return g


def anchors(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first and last start of the strings it anchors, row, prefix sums) for each anchor of a block."""
    sums = prefix_sums(BYTE[b.buf])
    none = np.zeros(0, np.int64)
    n = len(b.buf)
    if n < LENGTH:
        return none.astype(U), none, none, none, sums
    g = rolling(sums)
    width, size = LENGTH - GRAM + 1, 1
    low = g
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if width > size:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    # a start counts if its string ends in the same row; a run ends where the hash or the row does
    new = np.empty(len(low) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(low[1:], low[:-1], out=new[1:-1])
    begin, end = b.off[:-1], np.maximum(b.off[1:] - LENGTH + 1, b.off[:-1])
    new[begin[begin < len(new)]] = True
    new[end[end < len(new)]] = True
    head = np.flatnonzero(new)
    first, last = head[:-1], head[1:] - 1
    row = np.searchsorted(b.off, first, "right") - 1
    own = first < end[row]
    first, last, row = first[own], last[own], row[own]
    return low[first], first, last, row, sums


def cut_runs(h, first, last, row):
    """Runs of at most 64 starts: a periodic text keeps one hash for long, and contexts stay short."""
    parts = (last - first) // 64 + 1
    k = np.repeat(np.arange(len(h)), parts)
    step = np.arange(len(k)) - np.repeat(starts(parts)[:-1], parts)
    a = first[k] + 64 * step
    return h[k], a, np.minimum(a + 63, last[k]), row[k]


def six(h: np.ndarray) -> bytes:
    """The low 48 bits of each hash."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unsix(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(U).ravel()


def _isin(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Membership in sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _pack(*columns: np.ndarray) -> np.ndarray:
    """One number for each tuple of small numbers, ordered alike; values are ranked where they don't fit 63 bits."""
    out, top = columns[0].astype(np.int64), int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        size = int(c.max(initial=0)) + 1
        if top * size >= 1 << 63:
            out = np.unique(out, return_inverse=True)[1]
            top = int(out.max(initial=0)) + 1
        out, top = out * size + c, top * size
    return out


def suffix_ranks(s: np.ndarray, need: int) -> np.ndarray:
    """A rank for each suffix of ``s`` (numbers above 0): suffixes that differ in their first ``need`` numbers are in order.

    The difference cover {1, 2} modulo 3; suffixes alike in ``need`` numbers have neighbouring or equal ranks.
    """
    n = len(s)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    if need <= 3 or n < 6:
        span = max(need, 3) if n >= 6 else max(n, 3)
        t = np.concatenate([t, np.zeros(span, np.int64)])
        return np.unique(_pack(*(t[k : k + n] for k in range(span))), return_inverse=True)[1]
    one, two = np.arange(1, n, 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    values, name = np.unique(_pack(t[sample], t[sample + 1], t[sample + 2]), return_inverse=True)
    rank = np.zeros(n + 3, np.int64)
    if len(values) == len(sample):
        rank[sample] = name + 1
    else:
        # a 0 keeps the two residues' names apart
        sub = suffix_ranks(np.concatenate([name[: len(one)] + 1, [0], name[len(one) :] + 1]), -(-need // 3))
        rank[sample] = np.delete(sub, len(one)) + 1
    zero = np.arange(0, n, 3)
    by_one = _pack(np.concatenate([t[zero], t[one]]), np.concatenate([rank[zero + 1], rank[one + 1]]))
    by_two = _pack(np.concatenate([t[zero], t[two]]), np.concatenate([t[zero + 1], t[two + 1]]), np.concatenate([rank[zero + 2], rank[two + 2]]))
    z1, k1, z2, k2, r1, r2 = (_sorted(x) for x in (by_one[: len(zero)], by_one[len(zero) :], by_two[: len(zero)], by_two[len(zero) :], rank[one], rank[two]))
    out = np.zeros(n, np.int64)
    out[zero] = _below(z1, z1) + _below(k1, z1) + _below(k2, z2)
    out[one] = _below(r1, r1) + _below(r2, r1) + _below(z1, k1)
    out[two] = _below(r1, r2) + _below(r2, r2) + _below(z2, k2)
    return out


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(x)
    return order, x[order]


def _below(values: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many values are smaller than each x, in the order that x had before it was sorted."""
    out = np.empty(len(x[0]), np.int64)
    # sorted needles walk the values once
    out[x[0]] = np.searchsorted(values[1], x[1])
    return out


def smallest_owner(data: np.ndarray, off: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each ``LENGTH`` bytes inside a context (contexts end at ``off``): its start in ``data``, and the smallest owner among equal ones."""
    size = np.diff(off)
    context = np.repeat(np.arange(len(size)), size)
    # contexts stand apart by a 0; bytes are 1 to 256
    text = np.insert(data.astype(np.int32) + 1, off[1:-1], 0)
    start = gather(np.arange(len(data)), off[:-1], np.maximum(size - LENGTH + 1, 0))
    if not len(start):
        return start, start
    order = start[np.argsort(suffix_ranks(text, LENGTH)[start + context[start]], kind="stable")]
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[order]
    new = np.ones(len(order), bool)
    new[1:] = (view[1:] != view[:-1]).any(1)
    head = np.flatnonzero(new)
    low = np.minimum.reduceat(owner[context[order]], head)
    out = np.zeros(len(data), np.int64)
    out[order] = np.repeat(low, np.diff(np.append(head, len(order))))
    return start, out[start]


def by_string(data: np.ndarray, off: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``smallest_owner`` of many contexts, in parts of ``CHUNK`` bytes or so: equal strings have equal hashes."""
    size = np.diff(off)
    start = gather(np.arange(len(data)), off[:-1], np.maximum(size - LENGTH + 1, 0))
    low = np.repeat(owner, np.maximum(size - LENGTH + 1, 0))
    if not len(start):
        return start, start
    key, out = span_hash(prefix_sums(BYTE[data]), start, start + LENGTH), np.zeros(len(start), np.int64)
    for at in _split((key % U(math.ceil(len(start) * LENGTH / CHUNK))).astype(np.int64)):
        # each distinct string once
        order = at[np.lexsort((low[at], key[at]))]
        head = np.append(True, key[order][1:] != key[order][:-1])
        one = order[head]
        own = smallest_owner(gather(data, start[one], np.full(len(one), LENGTH)), np.arange(len(one) + 1) * LENGTH, low[one])[1]
        out[order] = own[np.cumsum(head) - 1]
    return start, out


def repeated_owner(data: np.ndarray, off: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``smallest_owner``, where only the stretches are sorted whose strings have another place by their hash."""
    size = np.diff(off)
    count = np.maximum(size - LENGTH + 1, 0)
    start, out = gather(np.arange(len(data)), off[:-1], count), np.repeat(owner, count)
    if not len(start):
        return start, start
    key = span_hash(prefix_sums(BYTE[data]), start, start + LENGTH)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(start), bool)
    again[order] = np.append(False, same) | np.append(same, False)
    at = np.flatnonzero(again)
    if not len(at):
        return start, out
    # starts of two contexts never follow one another
    head = np.flatnonzero(np.append(True, np.diff(start[at]) > 1))
    first, run = start[at[head]], np.diff(np.append(head, len(at)))
    text, sub = gather(data, first, run + LENGTH - 1), starts(run + LENGTH - 1)
    out[at] = (smallest_owner if len(text) <= 4 * CHUNK else by_string)(text, sub, out[at[head]])[1]
    return start, out


def _names(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each context's hash, and that of its anchor: its smallest gram, which all of its strings have.

    Contexts are hashed by the megabyte, whatever a task holds.
    """
    key, anchor, i = np.zeros(len(off) - 1, U), np.zeros(len(off) - 1, U), 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + (1 << 20), "right")) - 1)
        at = off[i : j + 1] - off[i]
        sums = prefix_sums(BYTE[data[off[i] : off[j]]])
        key[i:j] = span_hash(sums, at[:-1], at[1:])
        g = np.append(rolling(sums), ~U(0))
        anchor[i:j] = np.minimum.reduceat(g, np.ravel(np.column_stack([at[:-1], at[1:] - GRAM + 1])))[::2]
        i = j
    return key, anchor


def _table(schema: T.StructType, rows: list[tuple]) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    own = to_arrow_schema(schema)
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(own)], schema=own)


def _split(key: np.ndarray) -> list[np.ndarray]:
    """Indices of equal keys together."""
    order = np.argsort(key, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(key[order])) + 1) if len(key) else []


def _schema(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


_LONG, _BIN = T.LongType(), T.BinaryType()
_SEEN = _schema(bucket=_LONG, homes=_BIN, n_once=_BIN, n_often=_BIN, once=_BIN, often=_BIN, several=_BIN, places=_BIN)
_SHARED = _schema(home=_LONG, cold=_BIN, hot=_BIN)
_CONTEXT = _schema(bucket=_LONG, home=_LONG, data=_BIN, size=_BIN, low=_BIN, more=_BIN)
_ANSWER = _schema(home=_LONG, hot=_BIN, key=_BIN, first=_BIN, last=_BIN, owner=_BIN)
_SPAN = T.ArrayType(_schema(start=_LONG, end=_LONG))
_OUT = _schema(doc=_LONG, n_bytes=_LONG, spans=_SPAN, kept=_BIN)


def _blocks(table: pa.Table) -> Iterator[tuple[Block, np.ndarray]]:
    doc, texts = table.column("doc").combine_chunks(), table.column("text").combine_chunks()
    for i, j in pieces(texts, _PIECE):
        yield Block(texts.slice(i, j - i)), doc.slice(i, j - i).to_numpy()


def seen_rows(h: np.ndarray, home: np.ndarray, places: np.ndarray, buckets: int) -> list[tuple]:
    """A row for each bucket, in which the homes lie one after the other: rows of a task don't grow with buckets times homes."""
    to, low = (h % U(buckets)).astype(np.int64), h & _LOW6
    order = np.lexsort((low, home, to))
    to, home, low = to[order], home[order], low[order]
    head = np.flatnonzero(np.append(True, (np.diff(to) != 0) | (np.diff(home) != 0) | (low[1:] != low[:-1])))
    once, count = np.diff(np.append(head, len(order))) == 1, np.add.reduceat(places[order], head)
    to, home, low = to[head], home[head], low[head]
    first = np.flatnonzero(np.append(True, (np.diff(to) != 0) | (np.diff(home) != 0)))
    n_once, n_all = (np.diff(np.append(x[first], x[-1])).astype(np.int32) for x in (starts(once), np.arange(len(to) + 1)))
    cut = np.append(np.flatnonzero(np.append(True, np.diff(to) != 0)), len(to))
    runs, rows = np.searchsorted(first, cut), []
    for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        r, own, one, n = slice(runs[k], runs[k + 1]), low[i:j], once[i:j], count[i:j]
        rows.append((int(to[i]), home[first[r]].astype(np.int32).tobytes(), n_once[r].tobytes(), (n_all[r] - n_once[r]).tobytes(), six(own[one]), six(own[~one]), six(own[n > 1]), n[n > 1].astype(np.uint32).tobytes()))
    return rows


def common_and_hot(once: list, often: list, several: list, places: list, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that two rows have, and those of more than ``hot`` places, from the blobs of all homes."""
    all_h, times = np.unique(np.concatenate(once + often), return_counts=True)
    # a blob has an anchor once however many places it has; those that are more are added
    more = np.concatenate(places).astype(np.int64) - 1
    count = times + np.bincount(np.searchsorted(all_h, np.concatenate(several)), more, len(all_h)).astype(np.int64)
    return np.union1d(all_h[times > 1], np.unique(np.concatenate(often))), all_h[count > hot]


def _own_strings(h, first, last, row, hot: np.ndarray):
    """Contexts of cold anchors and single strings of hot ones: (anchor hash or None, first start, last start, row)."""
    is_hot = _isin(h & _LOW6, hot)
    count = np.where(is_hot, last - first + 1, 1)
    k = np.repeat(np.arange(len(h)), count)
    step = np.arange(len(k)) - np.repeat(starts(count)[:-1], count)
    a = first[k] + step
    return is_hot[k], h[k], a, np.where(is_hot[k], a, last[k]), row[k]


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """doc, n_bytes, spans (the maximal runs of bytes to remove) and kept (the other bytes) of each row."""
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
            h, home, places = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = seen_rows(h, home, places, buckets)
            held.clear()
            return _table(_SEEN, rows).combine_chunks().to_batches()[0]

        for batch in batches:
            home = batch.column("home").to_numpy()
            for i, j in pieces(batch.column("text"), _PIECE):
                b = Block(batch.column("text").slice(i, j - i))
                h, start, end, row, _ = anchors(b)
                if len(h):
                    # once for each row, however often the row has it
                    order = np.lexsort((h, row))
                    new = np.ones(len(h), bool)
                    new[1:] = (np.diff(row[order]) > 0) | (h[order][1:] != h[order][:-1])
                    # as many places as contexts, see cut_runs
                    places = np.add.reduceat(((end - start) // 64 + 1)[order], np.flatnonzero(new))
                    held.append((h[order][new], home[i:j][row[order][new]], places))
                    count += len(held[-1][0])
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def shared(table: pa.Table) -> pa.Table:
        once, often, several = ([unsix(x) for x in table.column(c).to_pylist()] for c in ("once", "often", "several"))
        common, busy = common_and_hot(once, often, several, [np.frombuffer(x, np.uint32) for x in table.column("places").to_pylist()], hot)
        homes, n_once, n_often = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int32) for c in ("homes", "n_once", "n_often"))
        once, often = np.concatenate(once), np.concatenate(often)
        shared_ = _isin(once, common)
        h, home = np.concatenate([once[shared_], often]), np.concatenate([np.repeat(homes, n_once)[shared_], np.repeat(homes, n_often)])
        order = np.lexsort((h, home))
        h, home = h[order], home[order]
        new = np.append(True, (np.diff(home) != 0) | (h[1:] != h[:-1]))[: len(h)]
        h, home = h[new], home[new]
        is_hot, every = _isin(h, busy), np.unique(home)
        cold, warm = (six(h[x]) for x in (~is_hot, is_hot))
        c, w = (6 * np.append(0, np.searchsorted(home[x], every, "right")) for x in (~is_hot, is_hot))
        return _table(_SHARED, [(k, cold[c[i] : c[i + 1]], warm[w[i] : w[i + 1]]) for i, k in enumerate(every.tolist())])

    def contexts(texts: pa.Table, marks: pa.Table) -> pa.Table:
        tidy()
        if not texts.num_rows or not marks.num_rows:
            return _table(_CONTEXT, [])
        busy = np.unique(np.concatenate([unsix(x) for x in marks.column("hot").to_pylist()]))
        known = np.union1d(np.unique(np.concatenate([unsix(x) for x in marks.column("cold").to_pylist()])), busy)
        home, rows, parts = texts.column("home")[0].as_py(), [], []
        for b, doc in _blocks(texts):
            h, first, last, row, sums = anchors(b)
            keep = _isin(h & _LOW6, known)
            is_hot, h, a, e, row = _own_strings(*cut_runs(h[keep], first[keep], last[keep], row[keep]), busy)
            if not len(h):
                continue
            key = span_hash(sums, a, e + LENGTH)
            order = np.lexsort((doc[row], key))
            head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            end = np.append(head[1:], len(order)) - 1
            at, low, high = order[head], doc[row[order[head]]], doc[row[order[end]]]
            to = (np.where(is_hot[at], key[at], h[at]) % U(buckets)).astype(np.int64)
            length = e[at] + LENGTH - a[at]
            parts.append((key[at], to, length, low, high, gather(b.buf, a[at], length)))
        if not parts:
            return _table(_CONTEXT, [])
        # one row for each bucket: rows grow with the text, not with buckets times blocks
        key, to, length, low, high, data = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        off, order = starts(length), np.lexsort((low, key))
        head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        at, high = order[head], np.maximum.reduceat(high[order], head)
        for own in _split(to[at]):
            i = at[own]
            rows.append((int(to[i[0]]), home, gather(data, off[i], length[i]).tobytes(), length[i].astype(np.uint8).tobytes(), low[i].tobytes(), (high[own] - low[i]).tobytes()))
        return _table(_CONTEXT, rows)

    def answers(table: pa.Table) -> pa.Table:
        tidy()
        data = np.frombuffer(b"".join(table.column("data").to_pylist()), np.uint8)
        length = np.frombuffer(b"".join(table.column("size").to_pylist()), np.uint8).astype(np.int64)
        low, more = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("low", "more"))
        home = np.repeat(table.column("home").to_numpy(), [len(x) for x in table.column("size").to_pylist()])
        off = starts(length)
        key, grams = _names(data, off)
        # every context once, with the smallest id that has it
        order = np.lexsort((low, key))
        head = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        which = np.zeros(len(key), np.int64)
        which[order] = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(order))))
        one, owner = order[head], low[order[head]]
        # contexts of one anchor go together
        own, anchor, times = np.unique(grams[one], return_inverse=True, return_counts=True)
        del grams, order
        # strings stand in their anchor's contexts alone: where there is one, it is their only place
        lone = np.flatnonzero(times[anchor] == 1)
        found_at, found_first, found_last, found_owner = [lone], [np.zeros(len(lone), np.int64)], [length[one[lone]] - LENGTH], [owner[lone]]
        several = np.flatnonzero(times[anchor] > 1)
        parts = max(1, math.ceil(length[one[several]].sum() / CHUNK))
        for own in _split(mix(own[anchor[several]]) % U(parts)):
            own = several[own]
            src = one[own]
            sub = starts(length[src])
            text = gather(data, off[src], length[src])
            start, least = repeated_owner(text, sub, owner[own])
            c = np.repeat(np.arange(len(own)), np.maximum(length[src] - LENGTH + 1, 0))
            # runs of one owner
            new = np.ones(len(start), bool)
            new[1:] = (np.diff(c) > 0) | (np.diff(least) != 0)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(start)) - 1
            found_at.append(own[c[head]])
            found_first.append((start - sub[c])[head])
            found_last.append((start - sub[c])[tail])
            found_owner.append(least[head])
        at, first, last, least = (np.concatenate(x) for x in (found_at, found_first, found_last, found_owner))
        order = np.argsort(at, kind="stable")
        at, first, last, least = at[order], first[order], last[order], least[order]
        count = np.bincount(at, minlength=len(one))
        rows = []
        for own in _split(home):
            own = own[np.unique(which[own], return_index=True)[1]] if len(own) < 2 else own
            w = which[own]
            e = gather(np.arange(len(at)), starts(count)[:-1][w], count[w])
            k = np.repeat(own, count[w])
            # of use only to a document with a larger id
            use = least[e] < low[k] + more[k]
            e, k = e[use], k[use]
            rows.append((int(home[own[0]]), b"", key[k].tobytes(), first[e].astype(np.uint8).tobytes(), last[e].astype(np.uint8).tobytes(), least[e].tobytes()))
        return _table(_ANSWER, rows)

    def removed(texts: pa.Table, found: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(found.column(name).to_pylist()), kind)

        tidy()
        if not texts.num_rows:
            return _table(_OUT, [])
        key, first, last, owner = joined("key", U), joined("first", np.uint8).astype(np.int64), joined("last", np.uint8).astype(np.int64), joined("owner", np.int64)
        busy = np.unique(unsix(b"".join(found.column("hot").to_pylist())))
        order = np.argsort(key, kind="stable")
        key, first, last, owner = key[order], first[order], last[order], owner[order]
        rows = []
        for b, doc in _blocks(texts):
            cover = np.zeros(len(b.buf) + 1, np.int64)
            h, f, e, row, sums = anchors(b)
            if len(h) and len(key):
                _, _, a, e, row = _own_strings(*cut_runs(h, f, e, row), busy)
                k = span_hash(sums, a, e + LENGTH)
                lo, hi = np.searchsorted(key, k), np.searchsorted(key, k, "right")
                hit = np.flatnonzero(hi > lo)
                x = gather(np.arange(len(key)), lo[hit], (hi - lo)[hit])
                y = np.repeat(hit, (hi - lo)[hit])
                use = owner[x] < doc[row[y]]
                x, y = x[use], y[use]
                np.add.at(cover, a[y] + first[x], 1)
                np.add.at(cover, a[y] + last[x] + LENGTH, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for r in range(b.rows):
                i, j = b.off[r], b.off[r + 1]
                own = np.flatnonzero(np.diff(np.concatenate([[False], gone[i:j], [False]]).astype(np.int8)))
                rows.append((int(doc[r]), int(j - i), [{"start": int(p), "end": int(q)} for p, q in own.reshape(-1, 2)], b.buf[i:j][~gone[i:j]].tobytes()))
        return _table(_OUT, rows)

    marks = source.select("home", "text").mapInArrow(seen, _SEEN).groupBy("bucket").applyInArrow(shared, _SHARED)
    # the texts are dealt once; both visits read the same exchange
    dealt = source.groupBy("home")
    found = dealt.cogroup(marks.groupBy("home")).applyInArrow(contexts, _CONTEXT).groupBy("bucket").applyInArrow(answers, _ANSWER)
    none = F.lit(b"")
    hot_marks = marks.where(F.length("hot") > 0).select("home", "hot", none.alias("key"), none.alias("first"), none.alias("last"), none.alias("owner"))
    return dealt.cogroup(found.unionByName(hot_marks).groupBy("home")).applyInArrow(removed, _OUT)


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """Each row's id and the text that is left; bytes of a character that was cut are dropped with it."""
    out = spans(docs, text, doc_id, **options)
    return out.select(F.when(F.col("doc") < _LAST, F.col("doc")).alias(doc_id), F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "").alias(text))


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return out.select(F.col("doc").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
