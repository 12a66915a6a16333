"""Line dedup across documents by a deletion-neighbourhood join.

A line goes if an equal line, or one within the edit bound, stands earlier: in a document with a smaller id, or
further up in the same one.  The bound follows the line's length: none for lines of fewer than ``min_chars``
characters (these go only if an equal one stands earlier), one character for all others.  Lines are judged on the
input, not on what is left, so the order of work does not matter.  Blank lines (no character above U+0020) stay.

Every line is hashed, and equal lines become one with its earliest place.  Two distinct lines within the bound
share their first or second half and differ by at most 1 in length, so four hashes a line find the lines that may
have a partner at all.  Only these emit their deletion neighbourhood:

- ``(position, line without that character)``: lines that share such a key differ in that character alone;
- the line without a character, which meets the line that equals it: the two are one deletion apart.

Within a key the relation holds for all members (first kind), or for the equal line and each of the others (second
kind), so a minimum over the key replaces pairs however many lines share it.  The pairs so chosen are verified by
their edit distance.

Defined cases: null and empty texts have no lines to judge.  A row is known by its id and a hash of its text, so
what one row loses never touches another with the same id; rows that share an id, or have none, are in order of that
hash, and rows alike in both are one place and keep or lose the same lines.  A null id comes after all others;
documents that repeat an earlier one lose every line; input columns named like a result give way; a text of any
length is cut whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .blocks import U, checkpointed, explode_blocks, lists, map_blocks, mix, prefix_sums, span_hash, starts

#: Lines of so many characters may differ by one from an earlier line; shorter ones are compared as they are.
MIN_CHARS = 20
#: Rows of suspected lines that are sent to all tasks; more are joined by shuffle.
BROADCAST_ROWS = 1 << 18
_LAST = (1 << 63) - 1
_NEWLINE = 10


class Lines:
    """The lines of a block of texts, cut at line feeds, as code points: row, number, begin and end of each."""

    def __init__(self, texts: pa.Array):
        own = [t or "" for t in texts.to_pylist()]
        self.codes = np.frombuffer("\n".join(own).encode("utf-32-le"), np.uint32)
        size = np.array([len(t) for t in own], np.int64)
        off = starts(size + 1)  # a line feed ends each text
        cut = np.append(np.flatnonzero(self.codes == _NEWLINE), len(self.codes))
        self.begin, self.end = np.append(0, cut[:-1] + 1), cut
        self.row = np.searchsorted(off, self.begin, "right") - 1
        first = np.searchsorted(self.row, np.arange(len(own)))
        self.number = np.arange(len(self.row)) - first[self.row]
        self.rows = len(own)
        self.filled = size > 0
        solid = starts(self.codes > 32)
        self.blank = solid[self.end] == solid[self.begin]

    def sums(self) -> np.ndarray:
        return prefix_sums(mix(self.codes.astype(U) + U(0x51ED270B)))


def _tag(h: np.ndarray, *tags) -> np.ndarray:
    for t in tags:
        h = mix(h ^ (np.asarray(t).astype(U) * U(0x9E3779B97F4A7C15)))
    return h


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


_LINE = T.StructType([T.StructField(c, T.LongType()) for c in ("doc", "row", "no", "h", "k0", "k1", "k2", "k3")])


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc, row (a hash that tells rows of one id apart) and text."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), row_hash(F.col(text)).alias("row"), F.col(text).alias("text"))


def row_hash(text):
    """60 bits of the text's MD5, which SQL has too; 0 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(0).cast("long"))


def lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """doc, row, no, hash and half keys (null for lines under ``min_chars``) of every line that is not blank."""

    def fn(texts: pa.Array, doc: pa.Array, row: pa.Array) -> list[pa.Array]:
        x = Lines(texts)
        s = x.sums()
        long = np.flatnonzero(~x.blank)
        b, e = x.begin[long], x.end[long]
        size = e - b
        short = size < min_chars
        halves = []
        for n in (size, size - 1):  # the class of lines of this length, and the one that a line with one more joins
            p = n // 2
            halves += [_tag(span_hash(s, b, b + p), n, 1), _tag(span_hash(s, e - (n - p), e), n, 2)]
        at = pa.array(x.row[long])
        return [doc.take(at), row.take(at), pa.array(x.number[long]), _signed(span_hash(s, b, e)), *(pa.array(h.view(np.int64), mask=short) for h in halves)]

    return explode_blocks(_rows(docs, text, doc_id), "text", ["doc", "row"], _LINE, fn)


def _suspect_texts(docs: DataFrame, suspects: DataFrame, text: str, doc_id: str) -> DataFrame:
    """h, doc, row, no, line: the earliest copies of suspected lines with their characters."""
    wanted = suspects.groupBy("doc", "row").agg(F.collect_list(F.struct("no", "h")).alias("want"))
    if suspects.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    source = _rows(docs, text, doc_id).join(wanted, ["doc", "row"])
    cut = source.select("doc", "row", F.explode("want").alias("w"), F.split("text", "\n").alias("l")).select(F.col("w.h").alias("h"), "doc", "row", F.col("w.no").alias("no"), F.get("l", F.col("w.no").cast("int")).alias("line"))
    # equal rows repeat a line
    return cut.where("line is not null").dropDuplicates(["h", "line"])


_KEY = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "doc", "row", "no", "key", "kind")])
SAME, LONGER, EQUAL = 0, 1, 2


def neighbourhood(suspects: DataFrame) -> DataFrame:
    """h, doc, row, no, key, kind of every variant of a line: SAME (one character masked), LONGER (one left out), EQUAL (itself)."""

    def fn(texts: pa.Array, *place: pa.Array) -> list[pa.Array]:
        x = Lines(texts)
        s, own, keys, kinds = x.sums(), [], [], []
        inverse = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        power = np.full(len(x.codes) + 1, inverse, U)
        power[0] = 1
        power = np.multiply.accumulate(power)
        for k, (b, e) in enumerate(zip(x.begin, x.end, strict=True)):
            n = int(e - b)
            i = np.arange(b, e)
            # the sum without character i: what stands behind it moves up by one power
            left = ((s[i] - s[b]) + (s[e] - s[i + 1]) * inverse) * power[b]
            variant = mix(left + np.full(1, n - 1, U) * U(0x632BE59BD9B4E019))
            full = span_hash(s, np.array([b]), np.array([e]))
            plain = np.unique(variant)
            found = [_tag(variant, n, i - b + 3), _tag(plain, 1), _tag(full, 1)]
            keys += found
            kinds += [np.full(len(f), kind) for f, kind in zip(found, (SAME, LONGER, EQUAL), strict=True)]
            own.append(np.full(sum(map(len, found)), k))
        at = pa.array(np.concatenate(own))
        return [*(c.take(at) for c in place), _signed(np.concatenate(keys)), pa.array(np.concatenate(kinds).astype(np.int64))]

    return explode_blocks(suspects, "line", ["h", "doc", "row", "no"], _KEY, fn, limit=1 << 14)


def near(suspects: DataFrame) -> DataFrame:
    """h of each distinct line with an earlier line at an edit distance of 1, verified on the characters."""
    key = W.partitionBy("key")
    place = F.struct("doc", "row", "no", "h")
    v = neighbourhood(suspects).select("h", "key", "kind", place.alias("at"))
    v = v.withColumns({
        "same": F.min(F.when(F.col("kind") == SAME, F.col("at"))).over(key),
        "longer": F.min(F.when(F.col("kind") == LONGER, F.col("at"))).over(key),
        "equal": F.min(F.when(F.col("kind") == EQUAL, F.col("at"))).over(key),
    })
    other = F.when(F.col("kind") == SAME, F.col("same")).when(F.col("kind") == LONGER, F.col("equal")).otherwise(F.col("longer"))
    pairs = v.select("h", "at", other.alias("other")).where("other < at").groupBy("h").agg(F.min("other").alias("other")).select("h", F.col("other.h").alias("g"))
    a, b = suspects.select("h", F.col("line").alias("a")), suspects.select(F.col("h").alias("g"), F.col("line").alias("b"))
    return pairs.join(a, "h").join(b, "g").where("levenshtein(a, b, 1) = 1").select("h").distinct()


def removed_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """doc (the id; the largest long for null), row (``row_hash`` of the text) and ``gone``, the ascending numbers (from 0) of its lines that go."""
    every = lines(docs, text, doc_id, min_chars)
    first = checkpointed(every.groupBy("h").agg(F.min(F.struct("doc", "row", "no")).alias("first"), F.count("*").alias("n"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))))
    keys = first.where("k0 is not null").select("h", F.explode(F.array(*(f"k{i}" for i in range(4)))).alias("k"))
    shared = keys.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("k")
    hashes = keys.join(shared, "k", "left_semi").select("h").distinct()
    suspects = checkpointed(first.join(hashes, "h", "left_semi").select("h", "first.*"))
    texts = checkpointed(_suspect_texts(docs, suspects, text, doc_id))
    judged = first.join(near(texts).withColumn("near", F.lit(True)), "h", "left").where("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = every.select("h", "doc", "row", "no").join(judged, "h").where(F.col("near") | (F.struct("doc", "row", "no") > F.col("first")))
    return gone.groupBy("doc", "row").agg(F.array_sort(F.collect_set("no")).alias("gone"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows of ``docs`` with the lines that stay, joined by line feeds; rows that lose every filled line go."""
    gone = removed_lines(docs, text, doc_id, min_chars).select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), F.col("gone").alias("_gone"))
    fields = docs.columns
    keyed = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(fields)), F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("_doc"), row_hash(F.col(text)).alias("_row"))
    joined = keyed.join(gone, ["_doc", "_row"], "left")
    old = F.col(f"_c{fields.index(text)}")
    kept = F.filter(F.split(old, "\n"), lambda x, i: ~F.array_contains("_gone", i.cast("long")))
    new = F.when(F.col("_gone").isNull(), old).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("_new", new).where(F.col("_gone").isNull() | F.col("_new").rlike(r"[^\x00-\x20]"))
    return out.select(*(F.col("_new" if c == text else f"_c{i}").alias(c) for i, c in enumerate(fields)))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with its number of lines and the numbers of those that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = docs.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), row_hash(F.col("text")).alias("row"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    out = counts.join(removed_lines(docs), ["doc", "row"], "left")
    gone = F.coalesce("gone", F.array().cast("array<bigint>"))
    return out.select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), gone.alias("removed"))
