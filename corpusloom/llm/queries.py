"""The queries of this subpackage and, where SQL expresses them, their SQL."""

import corpus_pipeline

from . import sql
from .decontaminate import op7_benchmark_decontamination
from .jaccard_join import op8_ngram_jaccard_join
from .license_scan import op5_license_scan
from .line_dedup import op9_line_dedup
from .quality import op6_quality_rules
from .sentencepiece_codec import op3_sentencepiece
from .suffix_dedup import op4_suffix_array_dedup
from .toxicity import op10_toxicity
from .url_filter import op1_url_filter
from .warc import op12_warc
from .window_dedup import op2_substring_dedup
from .yinyang import op11_centroid_clustering

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_quality_rules": op6_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_warc": op12_warc,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = dict(sql.SQL)
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
