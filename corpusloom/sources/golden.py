"""Golden question-and-answer sets in JSON: arrays of entries, or an entry a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "item_id string, question string, expected_file string, expected_symbol string, match_mode string, answer_keywords array<string>, min_chunks_in_context double"


def read_golden(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The entries of all files below ``path``, with defaults for what is missing: empty expectations, mode ``either``, no keywords.

    An entry without an id gets a hash of its question and expectations; one without a question, and a file or line that
    is no JSON, is left out.
    """
    rows = spark.read.schema(ENTRY).option("multiLine", str(not lines).lower()).json(path).where("question is not null")
    texts = {c: F.coalesce(c, F.lit("")) for c in ("expected_file", "expected_symbol")}
    own = F.left(F.md5(F.concat_ws("|", "question", "expected_file", "expected_symbol")), F.lit(16))
    return rows.withColumns(texts).withColumns({
        "match_mode": F.coalesce("match_mode", F.lit("either")), "answer_keywords": F.coalesce("answer_keywords", F.array().cast("array<string>")), "item_id": F.coalesce("item_id", own),
    })
