"""Benchmark decontamination: a broadcast hash set of the test set's word n-grams, scanned over all texts.

Words are runs of letters, digits and characters beyond ASCII after A-Z are lowered.  A window is ``n``
consecutive words of an item; a shorter item with a word is one window.  Each hit of a window's hash is
compared word by word before it counts.

Items are broadcast in parts of about ``part_bytes`` of text, dealt by hash: the text itself and 24 bytes a window, so
4 to 5 times the text for words of common length and 13 times it at most.  Each part is one more pass of narrow work
over the texts, so a large test set costs time and not memory.

Defined cases: null and empty texts have no words and no hits; items with a null id or text are left out;
items that share an id count once; every input row gives one output row, repeated ids included; an empty
benchmark hits nothing; input columns named like a result column give way to it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ALNUM, U, Block, lists, map_blocks, starts

SPAN = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
_SCAN = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])


def _windows(items: list[tuple[str, str]], n: int) -> tuple[bytes, list[str], dict[int, tuple[np.ndarray, ...]]]:
    """All items' words as one buffer, the ids, and by length the windows: sorted hashes, place and length in the buffer, number of the id."""
    names = sorted({i for i, _ in items})
    number = {name: k for k, name in enumerate(names)}
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    buffer, total = [], 0
    for item, text in items:
        b = Block(pa.array([text], pa.large_string()), lower=True)
        b.words(ALNUM)
        size = min(n, len(b.start))
        if not size:
            continue
        words, length = b.cut(0, len(b.start)), b.end - b.start
        begin = starts(length + 1)[:-1]
        at, h = b.grams(b.word_hashes(), size)
        begin, stop = begin[at], begin[at + size - 1] + length[at + size - 1]
        # a window that the item repeats is held once
        _, first, same = np.unique(h, return_index=True, return_inverse=True)
        own = np.zeros(len(h), bool)
        own[first] = True
        for i in np.flatnonzero(~own).tolist():
            j = first[same[i]]
            own[i] = words[begin[i] : stop[i]] != words[begin[j] : stop[j]]
        found.setdefault(size, []).append((h[own], begin[own] + total, (stop - begin)[own].astype(np.int32), np.full(own.sum(), number[item], np.int32)))
        buffer.append(words)
        total += len(words)
    out = {}
    for size, parts in found.items():
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        out[size] = tuple(c[order] for c in columns)
    return b"".join(buffer), names, out


def _sieve(keys: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(keys >> U(44)).astype(np.int64)] = True
    return out


def _scan(df: DataFrame, text: str, keep: list[str], shared) -> DataFrame:
    """One pass: the words hit and the items found by the windows of ``shared``, added to those of earlier passes."""
    state: dict = {}

    def fn(texts: pa.Array) -> list[pa.Array]:
        if not state:
            state.update({size: (*columns, _sieve(columns[0])) for size, columns in shared.value[2].items()})
        b = Block(texts, lower=True)
        b.words(ALNUM)
        h = b.word_hashes()
        hit = np.zeros(len(h), bool)
        items: list[set] = [set() for _ in range(b.rows)]
        buffer, names = shared.value[:2]
        for size, (keys, begin, length, item, sieve) in state.items():
            at, g = b.grams(h, size)
            maybe = np.flatnonzero(sieve[(g >> U(44)).astype(np.int64)])
            at, g = at[maybe], g[maybe]
            low, high = np.searchsorted(keys, g), np.searchsorted(keys, g, "right")
            some = high > low
            for i, a, z in zip(at[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                own = b.cut(i, i + size)
                for k in range(a, z):
                    if buffer[begin[k] : begin[k] + length[k]] == own:
                        hit[i : i + size] = True
                        items[b.row[i]].add(names[item[k]])
        words = np.flatnonzero(hit)
        each = np.bincount(b.row[words], minlength=b.rows)
        local = (words - b.first[b.row[words]]).astype(np.int32) if len(words) else np.zeros(0, np.int32)
        return [pa.array(np.diff(b.first)), lists(local, each), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]

    return map_blocks(df, text, keep, _SCAN, fn)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, keep: list[str] | None = None, part_bytes: int = 4 << 20) -> DataFrame:
    """``keep`` columns (all by default) with n_words, hit_words (their numbers, ascending) and items (ids as strings, sorted)."""
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in _SCAN.names]
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    out = None
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()
        shared = spark.sparkContext.broadcast(_windows([(r.i, r.t) for r in rows], n))
        if out is None:
            # the text is needed again only if more passes follow
            out = _scan(docs, text, keep if parts == 1 else list(dict.fromkeys([*keep, text])), shared)
        else:
            more = _scan(out.withColumnsRenamed({c: f"_{c}" for c in _SCAN.names}), text, [*dict.fromkeys([*keep, text]), "_hit_words", "_items"], shared)
            out = more.select(*dict.fromkeys([*keep, text]), "n_words", F.array_sort(F.array_union("hit_words", "_hit_words")).alias("hit_words"), F.array_sort(F.array_union("items", "_items")).alias("items"))
    return out.select(*keep, *_SCAN.names)


def contaminated(percent: int = 5):
    """The contract's rule: some word is hit, and those hit are at least ``percent`` of all."""
    hits = F.size("hit_words").cast("long")
    return (hits > 0) & (hits * 100 >= percent * F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", percent: int = 5, **options) -> DataFrame:
    """Clean rows with the columns of ``docs``.

    ``remove="documents"`` drops contaminated rows; ``"spans"`` keeps them and cuts from the text each run of
    words hit, from its first byte to the last byte of its last word.
    """
    # a column named like a result is put aside
    aside = {c: f"_own_{c}" for c in docs.columns if c in _SCAN.names}
    back = {v: k for k, v in aside.items()}
    text = aside.get(text, text)
    docs = docs.withColumnsRenamed(aside)
    out = scan(docs, benchmark, text, **options)
    if remove == "documents":
        return out.where(~contaminated(percent)).select(*docs.columns).withColumnsRenamed(back)
    if remove != "spans":
        raise ValueError(f"remove must be documents or spans, not {remove!r}")
    schema = T.StructType([*docs.schema.fields])

    def cut(batches):
        for b in batches:
            new = []
            for t, hits in zip(b.column(text).to_pylist(), b.column("hit_words").to_pylist(), strict=True):
                if hits:
                    x = Block(pa.array([t], pa.large_string()), lower=True)
                    x.words(ALNUM)
                    raw, gone = t.encode(), np.zeros(len(x.buf), bool)
                    runs = np.split(np.array(hits), np.flatnonzero(np.diff(hits) > 1) + 1)
                    for r in runs:
                        gone[x.start[r[0]] : x.end[r[-1]]] = True
                    t = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode()
                new.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == text else b.column(c) for c in schema.names], names=schema.names)

    return out.select(*docs.columns, "hit_words").mapInArrow(cut, schema).withColumnsRenamed(back)


def op7_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return out.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
