"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is read here field by field, and its normaliser, white-space marker, scores (unigram)
or merges (BPE) and byte fallback are rebuilt as one ``tokenizers.Tokenizer``, which encodes batches on
several threads where whole texts go to it.  Ids are those of the SentencePiece library; ``parity`` compares the two.

Where no piece runs from a word into the next marker, a text is the sequence of its marker-led words, each
encoded alone: a block's distinct words go to the library's model one by one, and a bounded memo keeps the common
ones.  Words are told apart by a 64-bit hash within a block and by their bytes in the memo.  ``parity="ids"``
encodes every whole text with the SentencePiece library too, and ``parity="texts"`` also lets it decode each row's ids;
``parity="words"`` encodes every distinct word when the memo learns it, a tenth of the work.

Only the model's bytes travel to the executors, at most ``MODEL_BYTES`` of them; each Python worker builds
its tokenizer once.

Defined cases: a null text gives null ids, null text and zero tokens; an empty text gives no ids and decodes
to an empty text; unknown characters become bytes where the model has byte pieces and ``<unk>`` elsewhere;
the strings of control pieces in a text are ordinary text; repeated rows are encoded row by row.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BYTE, Block, gather, pieces, prefix_sums, reach, span_hash, starts, tidy

#: Where the public vocabularies lie unless a caller names another model.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MODEL_BYTES = 64 << 20
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE_PIECE = 1, 2, 3, 4, 5, 6
_ENCODE_BYTES = 1 << 18
#: Distinct words that a worker remembers within a task.
MEMO = 1 << 18
#: Threads of a worker's tokenizer, unless RAYON_NUM_THREADS says otherwise: more than a task's cores only spin.
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; numbers, floats and nested messages as they lie."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return out, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """Pieces (text, score, kind), model type (1 unigram, 2 BPE), byte fallback, and the normaliser's settings."""
    model = {"pieces": [], "type": 1, "byte_fallback": False, "unk_surface": " ⁇ ", "charsmap": b"", "dummy_prefix": True, "squeeze": True, "escape": True}
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                piece, score, kind = (v.decode() if n == 1 else piece), (struct.unpack("<f", v)[0] if n == 2 else score), (v if n == 3 else kind)
            model["pieces"].append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model["type"] = v
                elif n == 35:
                    model["byte_fallback"] = bool(v)
                elif n == 44:
                    model["unk_surface"] = v.decode()
        elif number == 3:
            for n, v in _fields(value):
                name = {2: "charsmap", 3: "dummy_prefix", 4: "squeeze", 5: "escape"}.get(n)
                if name:
                    model[name] = v if n == 2 else bool(v)
    return model


def merges(pieces_: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """BPE merges in the order in which SentencePiece prefers them: by the joined piece's score, best first."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces_) if kind in (NORMAL, USER, UNUSED)}
    found = []
    for p, i in ids.items():
        own = [(ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        found += [(-pieces_[i][1], i, a, b, x, y) for a, b, x, y in own]
    return [(x, y) for *_, x, y in sorted(found)]


def apart(m: dict) -> bool:
    """Whether words are encoded apart: no piece has a marker after another character."""
    mark = MARK if m["escape"] else " "
    return not any(a != mark and b == mark for p, _, kind in m["pieces"] if kind in (NORMAL, USER) for a, b in zip(p, p[1:], strict=False))


def build(data: bytes):
    """A tokenizer that gives the SentencePiece model's ids and texts."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    m = parse_model(data)
    unk = next((i for i, x in enumerate(m["pieces"]) if x[2] == UNKNOWN), 0)
    # a control piece's own text must never be found in a text
    names = [p if kind != CONTROL else f"\0control{i}" for i, (p, _, kind) in enumerate(m["pieces"])]
    if m["type"] == 1:
        model = models.Unigram([(p, s) for p, (_, s, _) in zip(names, m["pieces"], strict=True)], unk_id=unk, byte_fallback=m["byte_fallback"])
    elif m["type"] == 2:
        model = models.BPE({p: i for i, p in enumerate(names)}, merges(m["pieces"]), unk_token=names[unk], fuse_unk=True, byte_fallback=m["byte_fallback"])
    else:
        raise ValueError(f"model type {m['type']} has no counterpart here: 1 (unigram) and 2 (BPE) have")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["squeeze"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if m["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    mark = MARK if m["escape"] else " "
    if apart(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{mark}+[^{mark}]*|[^{mark}]+"), "isolated")
    end = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    t.decoder = decoders.Sequence(end + ([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else []))
    t.encode_special_tokens = True
    return t


class Codec:
    """One Python worker's tokenizer, its memo of words and the bytes of its pieces."""

    def __init__(self, data: bytes, check: str = ""):
        self.processor, self.by_memo = None, check == "words"
        if check:
            import sentencepiece

            self.processor = sentencepiece.SentencePieceProcessor(model_proto=data)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        self.tokenizer = build(data)
        m = parse_model(data)
        # the memo stands for texts that are not normalised beyond the marker
        self.by_word = apart(m) and m["escape"] and m["dummy_prefix"] and not m["charsmap"] and not m["squeeze"]
        if self.by_word:
            # words come with their marker; decoding needs neither of the two
            self.tokenizer.normalizer = None
            self.tokenizer.pre_tokenizer = None
        self.prefix = m["dummy_prefix"]
        own = [bytes([int(p[3:5], 16)]) if kind == BYTE_PIECE else p.replace(MARK, " ").encode() if kind in (NORMAL, USER) else b"" for p, _, kind in m["pieces"]]
        self.plain = np.array([kind in (NORMAL, USER, BYTE_PIECE) for *_, kind in m["pieces"]])
        self.size = np.array([len(x) for x in own])
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.bytes = np.frombuffer(b"".join(own), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.memo, self.ids, self.begin, self.count, self.same, self.used = {}, np.zeros(1 << 16, np.int32), np.zeros(MEMO, np.int64), np.zeros(MEMO, np.int64), np.ones(MEMO, bool), 0

    def learn(self, words: list[bytes]) -> None:
        # a word has nothing to normalise or to split, so the model takes it as it is: half the time of an encoding each
        tokenize = self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(w.decode().replace(" ", MARK))] for w in words]
        k, n = len(self.memo), len(words)
        count = np.fromiter(map(len, got), np.int64, n)
        end = self.used + int(count.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), np.int32)])
        self.ids[self.used : end] = np.fromiter(chain.from_iterable(got), np.int32, end - self.used)
        self.begin[k : k + n], self.count[k : k + n] = self.used + starts(count)[:-1], count
        if self.by_memo:
            # a word's first blank is the marker that the library adds itself
            self.same[k : k + n] = [x == y for x, y in zip(got, self.processor.encode([w[1:].decode() for w in words], num_threads=1), strict=True)]
        self.memo.update(zip(words, range(k, k + n), strict=True))
        self.used = end

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of a block, how many each text has, and whether the library agrees on its words."""
        if not self.by_word:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts.fill_null("").to_pylist(), add_special_tokens=False)]
            count = np.array([len(x) for x in got], np.int64)
            return np.fromiter(chain.from_iterable(got), np.int32, int(count.sum())), count, np.ones(len(count), bool)
        b = Block(pc.replace_substring(texts, MARK, " "))
        filled = np.flatnonzero(np.diff(b.off))
        if not len(filled):
            return np.zeros(0, np.int32), np.zeros(b.rows, np.int64), np.ones(b.rows, bool)
        buf = np.insert(b.buf, b.off[filled], 32)  # the marker before a text
        off = b.off[filled] + np.arange(len(filled))
        blank = buf == 32
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[off] = True
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(buf))
        hashes = pa.array(span_hash(prefix_sums(BYTE[buf]), start, end)).dictionary_encode()
        which, first = hashes.indices.to_numpy(), np.empty(len(hashes.dictionary), np.int64)
        first[which[::-1]] = np.arange(len(which))[::-1]  # the first place is written last
        own = [buf[i:j].tobytes() for i, j in zip(start[first], end[first], strict=True)]
        new = [w for w in own if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.forget()
            new = own
        if len(new) > len(self.count):  # one huge text
            self.begin, self.count, self.same = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64), np.ones(len(new), bool)
        self.learn(new)
        slot = np.array([self.memo[w] for w in own])[which]
        ids, each = gather(self.ids, self.begin[slot], self.count[slot]), self.count[slot]
        total, same, at = np.zeros(b.rows, np.int64), np.ones(b.rows, bool), np.searchsorted(start, off)
        total[filled], same[filled] = np.add.reduceat(each, at), np.logical_and.reduceat(self.same[slot], at)
        return ids, total, same

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of ids; rows with unknown or control pieces, or bytes that are no characters, go through the library."""
        row = np.repeat(np.arange(len(count)), count)
        size = np.bincount(row, self.size[ids], len(count)).astype(np.int64)
        data, out, cut, at = gather(self.bytes, self.at[ids], self.size[ids]).tobytes(), [], starts(size), starts(count)
        odd = np.bincount(row, ~self.plain[ids], len(count)) > 0
        for k in range(len(count)):
            i, j = cut[k], cut[k + 1]
            try:
                text = None if odd[k] else data[i + (self.prefix and data[i : i + 1] == b" ") : j].decode()
            except UnicodeDecodeError:
                text = None
            out.append(self.tokenizer.decode(ids[at[k] : at[k + 1]].tolist(), skip_special_tokens=False) if text is None else text)
        return out


_codecs: dict[tuple, Codec] = {}


def _codec(data: bytes, check: str = "") -> Codec:
    key = hashlib.sha256(data).digest(), check
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(data, check)
    return _codecs[key]


def _load(model: str) -> bytes:
    data = Path(model).read_bytes()
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{model} has {len(data)} bytes; at most {MODEL_BYTES} are sent to executors")
    return data


def _same_ids(flat: np.ndarray, count: np.ndarray, other: list[list[int]]) -> np.ndarray:
    """Row by row, whether the ids are those of the other side."""
    size = np.fromiter(map(len, other), np.int64, len(other))
    theirs = np.fromiter(chain.from_iterable(other), np.int32, int(size.sum()))
    same = size == count
    off, row = starts(size)[:-1], np.repeat(np.arange(len(count)), np.where(same, count, 0))
    mine, their = (gather(x, y, np.where(same, count, 0)) for x, y in ((flat, starts(count)[:-1]), (theirs, off)))
    same[row[mine != their]] = False
    return same


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, keep: list[str] | None = None, parity: str = "", decoded: bool = False, ids: bool = True) -> DataFrame:
    """``keep`` columns (all by default) with n_tokens and, as asked for, ids, decoded (the ids' text) and parity.

    ``parity`` is true where the SentencePiece library gives the same ids for the whole text ("ids"), and decodes them
    to the same text ("texts"); "words" compares the ids of each distinct word and the decoded text.
    """
    if parity not in ("", "words", "ids", "texts"):
        raise ValueError(f"parity must be words, ids or texts, not {parity!r}")
    data = _load(model)
    fields = [T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.StringType())] * decoded + [T.StructField("parity", T.BooleanType())] * bool(parity)
    added = [f.name for f in fields]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    source = docs.select(*(docs[c] for c in dict.fromkeys([*keep, text])))
    schema = T.StructType([*(source.schema[c] for c in keep), *fields])

    def run(batches):
        codec = _codec(data, parity)
        for b in batches:
            for i, j in pieces(b.column(text), _ENCODE_BYTES):
                part = b.column(text).slice(i, j - i)
                flat, count, same = codec.encode(part)
                null = part.is_null().to_numpy(zero_copy_only=False)
                out = {"n_tokens": pa.array(count)}
                if ids:
                    at = pa.array(np.append(starts(count)[:-1], len(flat)).astype(np.int32), mask=np.append(null, False))
                    out["ids"] = pa.ListArray.from_arrays(at, pa.array(flat))
                if decoded or parity in ("words", "texts"):
                    back = codec.decode(flat, count)
                    out["decoded"] = pa.array(back, pa.string(), mask=null)
                at, n = starts(count), len(count)
                if parity in ("ids", "texts") or parity and not codec.by_word:
                    same = _same_ids(flat, count, codec.processor.encode(part.fill_null("").to_pylist(), num_threads=1))
                if parity in ("words", "texts"):
                    own = [flat[k:m].tolist() for k, m in zip(at, at[1:], strict=False)]
                    same &= np.fromiter((x == y for x, y in zip(back, codec.processor.decode(own, num_threads=1), strict=True)), bool, n)
                if parity:
                    out["parity"] = pa.array(same)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in keep), *(out[n] for n in added)], names=schema.names)
        codec.forget()
        tidy()

    reach(docs.sparkSession)
    return source.mapInArrow(run, schema)


def decode(encoded: DataFrame, ids: str = "ids", to: str = "text", model: str = MODEL) -> DataFrame:
    """All columns but ``ids``, with the text of the ids in ``to``; null ids give a null text."""
    data = _load(model)
    keep = [c for c in encoded.columns if c not in (ids, to)]
    source = encoded.select(*keep, ids)
    schema = T.StructType([*(source.schema[c] for c in keep), T.StructField(to, T.StringType())])

    def run(batches):
        codec = _codec(data)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                own = b.column(ids).slice(i, 64)
                flat, count = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(own).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, 64) for c in keep), pa.array(codec.decode(flat, count), pa.string(), mask=own.is_null().to_numpy(zero_copy_only=False))], names=schema.names)

    reach(encoded.sparkSession)
    return source.mapInArrow(run, schema)


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Ids of every whole document, their digest, and whether they decode to the text and match the library."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = encode(docs, keep=["doc_id", "text"], parity="ids", decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "parity")
