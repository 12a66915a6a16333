"""Token counts by a public byte-pair vocabulary, over Arrow batches."""

from __future__ import annotations

import base64
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a text is cut before bytes are merged. Fixed value of the public vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_made: dict[str, object] = {}


def _encoding(name: str, pattern: str, ranks: bytes):
    """One encoder a worker and vocabulary."""
    if name not in _made:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _made[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _made[name]


def counter(spark: SparkSession, vocabulary: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """A function that counts the tokens of a text column by the ranks in a file (a token in base64 and its rank a line).

    The file is read on the driver and sent to the workers: a vocabulary is a few megabytes, whatever the corpus.  Null
    has no count; special tokens' strings are ordinary text.
    """
    shared, name = spark.sparkContext.broadcast(Path(vocabulary).read_bytes()), f"{vocabulary}:{pattern}"

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        encoding = _encoding(name, pattern, shared.value)
        found = encoding.encode_ordinary_batch([t or "" for t in texts.to_pylist()], num_threads=1)
        return pa.array([len(x) if known else None for known, x in zip(texts.is_valid().to_pylist(), found, strict=True)], pa.int64())

    return count
