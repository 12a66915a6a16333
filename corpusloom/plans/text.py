"""Queries over files, chunks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import catalog, chunking, manifest
from ..sources import files as S
from ..sources.tables import FILES_SQL, files, table

_QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
_EXT = "lower(regexp_extract(regexp_extract(rel_path, '([^/]*)$', 1), '^.+(\\.[^.]+)$', 1))"
TOKENS_SQL = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"
WINDOWS_SQL = """l AS (SELECT *, string_split(text, chr(10)) AS lines FROM {src}),
i AS (SELECT *, unnest(range(0, CAST(ceil(len(lines) / 45.0) AS BIGINT))) AS i FROM l),
windows AS (SELECT * FROM (SELECT {keys}, i AS chunk_no, 45 * i + 1 AS start_line, least(45 * i + 60, len(lines)) AS end_line,
  array_to_string(list_slice(lines, 45 * i + 1, 45 * i + 60), chr(10)) AS text FROM i) WHERE regexp_matches(text, '\\S'))"""
FILE_WINDOWS_SQL = f"{FILES_SQL}, {WINDOWS_SQL.format(src='files', keys='repo_id, doc_id, rel_path, lang')}"
QUERIES, SQL = {}, {}


def _q(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@_q("sliding_windows", f"WITH {WINDOWS_SQL.format(src='documents', keys='doc_id')} SELECT * FROM windows")
def _(spark, d):
    return chunking.windows(table(spark, d, "documents").select("doc_id", "text"))


_CAP = f"CASE WHEN {_EXT} IN ({_QUOTED(config.HTML_EXTENSIONS)}) THEN 20 WHEN {_EXT} IN ({_QUOTED(config.DOC_EXTENSIONS)}) THEN 0 WHEN {_EXT} IN ({_QUOTED(config.CODE_EXTENSIONS)}) THEN 40 ELSE 20 END"


@_q("sliding_windows_capped", f"WITH {FILE_WINDOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rel_path, doc_id ORDER BY chunk_no) AS k, {_CAP} AS cap FROM windows) SELECT rel_path, chunk_no, start_line, end_line FROM r WHERE (cap = 0 OR k <= cap // 20) AND k <= 2")
def _(spark, d):
    # a twentieth of the caps, and two a file, so that they bite on short texts
    cap = (chunking.window_cap(F.col("rel_path")) / 20).cast("int")
    return chunking.windows(files(spark, d), caps=[cap, 2]).select("rel_path", "chunk_no", "start_line", "end_line")


@_q("window_cap_rule", f"WITH {FILES_SQL} SELECT rel_path, {_CAP} AS cap FROM files")
def _(spark, d):
    return files(spark, d).select("rel_path", chunking.window_cap(F.col("rel_path")).alias("cap"))


_LANG = "CASE " + " ".join(f"WHEN {_EXT} = '{k}' THEN '{v}'" for k, v in config.LANGUAGES.items()) + " END"


@_q("language_resolve", f"WITH {FILES_SQL} SELECT rel_path, {_LANG} AS language FROM files")
def _(spark, d):
    return files(spark, d).select("rel_path", S.language(F.col("rel_path")).alias("language"))


def _nested(f):
    """Files below a directory that depends on the id: two in seven are pruned."""
    lead = F.when(F.col("doc_id") % 7 == 0, "build/").when(F.col("doc_id") % 7 == 1, "lib/vendor/").otherwise("src/")
    return f.withColumn("rel_path", F.concat(lead, "rel_path"))


_NESTED = f"{FILES_SQL}, nested AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'build/' WHEN 1 THEN 'lib/vendor/' ELSE 'src/' END || rel_path AS rel_path FROM files)"


@_q("skip_dir_prune", f"WITH {_NESTED} SELECT rel_path FROM nested WHERE NOT list_has_any(string_split(rel_path, '/'), [{_QUOTED(config.SKIP_DIRS)}])")
def _(spark, d):
    return _nested(files(spark, d)).where(~S.is_pruned(F.col("rel_path"))).select("rel_path")


@_q("file_scan_classify", f"WITH {_NESTED}, c AS (SELECT rel_path, {_LANG} AS language FROM nested WHERE NOT list_has_any(string_split(rel_path, '/'), [{_QUOTED(config.SKIP_DIRS)}])) SELECT rel_path, language, CASE WHEN language IS NULL THEN 'skipped' ELSE 'indexed' END AS status FROM c")
def _(spark, d):
    return S.classify(_nested(files(spark, d))).select("rel_path", "language", "status")


#: A character cut at the end of the probed bytes leaves the share of printable ASCII bytes to decide.
_HEX = "hex(encode(text))"
_RATIO = f"len(list_filter(regexp_extract_all(substr({_HEX}, 1, 16384), '..'), lambda x: x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E')) / 8192.0 >= 0.85"


@_q("text_probe", f"SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN false WHEN strlen(text) > 8192 AND substr({_HEX}, 16385, 2) BETWEEN '80' AND 'BF' THEN {_RATIO} ELSE true END AS is_text FROM documents")
def _(spark, d):
    # every tenth text gets a NUL in front
    content = F.concat(F.when(F.col("doc_id") % 10 == 3, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))), F.col("text").cast("binary"))
    return table(spark, d, "documents").select("doc_id", S.is_text(content).alias("is_text"))


#: A character that the cap cuts through is one replacement character, so characters are counted by their first bytes.
@_q("capped_read", f"SELECT doc_id, len(list_filter(regexp_extract_all(substr({_HEX}, 1, 2000), '..'), lambda x: x NOT BETWEEN '80' AND 'BF')) AS capped_len, strlen(text) > 1000 AS truncated FROM documents")
def _(spark, d):
    text, truncated = S.read_capped(F.col("text").cast("binary"), 1000)
    return table(spark, d, "documents").select("doc_id", F.length(text).cast("long").alias("capped_len"), truncated.alias("truncated"))


@_q("tokenize_terms", f"WITH t AS (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL")
def _(spark, d):
    from ..operators.bm25 import postings

    return postings(table(spark, d, "documents"))


@_q("approx_token_count", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS n_tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.token_count(F.col("text")).alias("n_tokens"))


@_q("vocabulary_token_count", None)
def _(spark, d, vocabulary="/opt/tokenizers/byte_bpe_50k.tiktoken"):
    """Tokens of each document by a public vocabulary, whose file is a parameter; tested against plain merges."""
    from ..functions.vocabulary import counter

    return table(spark, d, "documents").select("doc_id", counter(spark, vocabulary)(F.col("text")).alias("n_tokens"))


@_q("embed_text_hash", f"WITH {FILES_SQL} SELECT rel_path, sha256('File: ' || rel_path || chr(10) || text) AS content_hash FROM files")
def _(spark, d):
    return files(spark, d).select("rel_path", X.content_hash(X.embed_text(F.col("rel_path"), F.col("text"))).alias("content_hash"))


@_q("embed_prompt_prepare", "WITH p AS (SELECT doc_id, 'search_document: ' || CASE WHEN regexp_matches(text, '\\S') THEN left(text, 8000) ELSE ' ' END AS p FROM documents) SELECT doc_id, length(p) AS prompt_len, md5(p) AS prompt_md5 FROM p")
def _(spark, d):
    p = X.embed_prompt(F.col("text"), "nomic-embed-text", "document")
    return table(spark, d, "documents").select("doc_id", F.length(p).cast("long").alias("prompt_len"), F.md5(p).alias("prompt_md5"))


_NORM = "regexp_replace(rtrim(trim(url), '/'), '(?i)\\.git$', '')"


@_q("url_normalize", f"SELECT page_id, {_NORM} AS url_norm FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalize_url(F.col("url")).alias("url_norm"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_DOMAIN = "regexp_extract(host, '([^.]+\\.[^.]+)$', 1)"


@_q("url_admission", f"WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages) SELECT page_id, host, starts_with(lower(url), 'https://') AND {_DOMAIN} IN ('example.com', 'example.org') AS admitted FROM h")
def _(spark, d):
    h = table(spark, d, "pages").select("page_id", "url", X.url_host(F.col("url")).alias("host"))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    return h.select("page_id", "host", (F.startswith(F.lower("url"), F.lit("https://")) & domain.isin("example.com", "example.org")).alias("admitted"))


#: Pages moved to hosts that are admitted, to some that only look like them, and to plain HTTP.
_MOVED = "CASE page_id % 6 WHEN 0 THEN 'https://github.com' WHEN 1 THEN 'https://GitLab.com:443' WHEN 2 THEN 'HTTPS://user@bitbucket.org' WHEN 3 THEN 'https://github.com.example.org' WHEN 4 THEN 'http://github.com' END"


@_q("url_allow_list", f"WITH m AS (SELECT page_id, CASE WHEN page_id % 6 < 5 THEN {_MOVED} || regexp_replace(url, '^[^:]*://[^/?#]*', '') ELSE url END AS url FROM pages) SELECT page_id, starts_with(lower(url), 'https://') AND {_HOST} IN ('github.com', 'gitlab.com', 'bitbucket.org') AS admitted FROM m")
def _(spark, d):
    url = F.when(F.col("page_id") % 6 < 5, F.concat(F.expr(_MOVED), F.regexp_replace("url", "^[^:]*://[^/?#]*", ""))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", X.admitted_url(url).alias("admitted"))


@_q("repo_id_hash", f"SELECT page_id, left(md5({_NORM}), 8) AS repo_id FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.repo_id(X.normalize_url(F.col("url"))).alias("repo_id"))


@_q("repo_size_guard", "WITH s AS (SELECT source, greatest(1, CAST(floor((floor(sum(strlen(text)) / 1024) + 1023) / 1024) AS BIGINT)) AS size_mb FROM documents GROUP BY source) SELECT source, size_mb, size_mb <= 1 AS admitted FROM s")
def _(spark, d):
    return catalog.size_guard(table(spark, d, "documents"), F.octet_length("text"), "source", 1)


def _cells(spark, d):
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    return chunking.notebook_cells(table(spark, d, "conversations"), "text", kind, F.col("turn") + 1, ["conv_id"])


@_q(
    "notebook_cells",
    """WITH c AS (SELECT conv_id, turn + 1 AS cell_no, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS k,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations),
s AS (SELECT *, string_split(text, chr(10)) AS lines, ceil(length(text) / 4.0) > 512 AS long FROM c WHERE k <> 'raw' AND text <> '' AND cell_no <= 100),
w AS (SELECT *, CASE WHEN long THEN unnest(range(0, CAST(ceil(len(lines) / 45.0) AS BIGINT))) ELSE 0 END AS i FROM s)
SELECT conv_id, cell_no, CASE k WHEN 'code' THEN 'python' ELSE k END AS language, 'cell_' || cell_no || '_' || k AS symbol_name, cell_no AS start_line,
  CASE WHEN long THEN cell_no + least(45 * i + 60, len(lines)) - (45 * i + 1) ELSE cell_no - 1 + len(lines) END AS end_line
FROM (SELECT * FROM w WHERE long UNION ALL SELECT * FROM (SELECT *, 0 AS i FROM s WHERE NOT long))""",
)
def _(spark, d):
    return _cells(spark, d).select("conv_id", "cell_no", "language", "symbol_name", "start_line", "end_line")


@_q(
    "code_chunks",
    f"WITH {FILE_WINDOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY rel_path, doc_id ORDER BY chunk_no) AS k FROM windows) SELECT rel_path, 'sliding_window' AS chunk_type, '' AS symbol_name, start_line, end_line FROM r WHERE k <= {config.CODE_WINDOW_CAP}",
)
def _(spark, d):
    """Documents as sources: none parses as Python, so windows come back; the chunker's rules are tested on sources."""
    f = files(spark, d).select("repo_id", "rel_path", "text", F.lit("python").alias("language"))
    return chunking.code_chunks(f).select("rel_path", "chunk_type", "symbol_name", F.col("start_line").cast("long"), F.col("end_line").cast("long"))


@_q("union_content_manifest", f"WITH {FILE_WINDOWS_SQL}, m AS (SELECT repo_id, ceil(count(DISTINCT rel_path) / 400.0) AS n FROM files GROUP BY 1) SELECT 'sliding_window' AS chunk_type, count(*) AS n FROM windows UNION ALL SELECT 'file_manifest', CAST(sum(n) AS BIGINT) FROM m")
def _(spark, d):
    f = files(spark, d)
    content = chunking.windows(f).select(F.lit("sliding_window").alias("chunk_type"))
    paths = manifest.distinct_paths(f)
    listed = manifest.manifest_chunks(paths).select(F.lit("file_manifest").alias("chunk_type"))
    return content.unionByName(listed).groupBy("chunk_type").agg(F.count("*").alias("n"))


@_q("indexed_minus_chunked", f"WITH f0 AS (SELECT * FROM (SELECT doc_id, source, lang, CASE WHEN doc_id % 50 = 0 THEN '  ' || chr(10) ELSE text END AS text FROM documents)), {FILES_SQL.replace('FROM documents', 'FROM f0')}, {WINDOWS_SQL.format(src='files', keys='rel_path')} SELECT rel_path FROM files WHERE rel_path NOT IN (SELECT rel_path FROM windows)")
def _(spark, d):
    f = files(spark, d).withColumn("text", F.when(F.col("doc_id") % 50 == 0, "  \n").otherwise(F.col("text")))
    return f.select("rel_path").join(chunking.windows(f).select("rel_path").distinct(), "rel_path", "left_anti")


@_q("embed_cache_hits", f"WITH {FILES_SQL}, h AS (SELECT rel_path, sha256('File: ' || rel_path || chr(10) || text) AS h FROM files) SELECT rel_path, h < '8' AS hit FROM h")
def _(spark, d):
    f = files(spark, d).select("rel_path", X.content_hash(X.embed_text(F.col("rel_path"), F.col("text"))).alias("content_hash"))
    cache = f.where("content_hash < '8'").select("content_hash").distinct().withColumn("vector", F.array(F.lit(1.0)))
    return catalog.cached(f, cache).select("rel_path", F.col("vector").isNotNull().alias("hit"))


@_q("embed_cache_misses", f"WITH {FILES_SQL}, h AS (SELECT rel_path, sha256('File: ' || rel_path || chr(10) || text) AS h FROM files) SELECT rel_path FROM h WHERE h >= '8'")
def _(spark, d):
    f = files(spark, d).select("rel_path", X.content_hash(X.embed_text(F.col("rel_path"), F.col("text"))).alias("content_hash"))
    cache = f.where("content_hash < '8'").select("content_hash").distinct()
    return catalog.missing(f, cache).select("rel_path")


@_q(
    "notebook_json_cells",
    """WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS cell_no, turn, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS k,
  regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM conversations WHERE conv_id % 10 <> 9),
s AS (SELECT *, string_split(text, chr(10)) AS lines, ceil(length(text) / 4.0) > 512 AS long FROM c WHERE k <> 'raw' AND text <> '' AND cell_no <= 100 AND turn % 7 <> 6),
w AS (SELECT *, unnest(range(0, CASE WHEN long THEN CAST(ceil(len(lines) / 45.0) AS BIGINT) ELSE 1 END)) AS i FROM s)
SELECT conv_id, cell_no, 'cell_' || cell_no || '_' || k AS symbol_name, cell_no AS start_line, CASE WHEN long THEN cell_no + least(45 * i + 60, len(lines)) - (45 * i + 1) ELSE cell_no - 1 + len(lines) END AS end_line,
  md5(CASE WHEN long THEN array_to_string(list_slice(lines, 45 * i + 1, 45 * i + 60), chr(10)) ELSE text END) AS text_md5 FROM w""",
)
def _(spark, d):
    """Conversations as notebooks in JSON: sources as texts and as lists of lines, cells whose source is a number, and every tenth notebook broken."""
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    lines = F.transform(F.split("text", "(?<=\n)"), lambda x: x)
    plain = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    source = F.when(F.col("turn") % 7 == 6, "12").when(F.col("turn") % 2 == 0, F.to_json(lines)).otherwise(plain)
    cell = F.concat(F.lit('{"cell_type":"'), kind, F.lit('","source":'), source, F.lit("}"))
    cells = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))), lambda x: x["c"]), ",")
    books = table(spark, d, "conversations").groupBy("conv_id").agg(cells.alias("c")).select("conv_id", F.when(F.col("conv_id") % 10 == 9, F.concat(F.lit('{"cells":['), "c")).otherwise(F.concat(F.lit('{"cells":['), "c", F.lit("]}"))).alias("text"))
    return chunking.notebook_chunks(books, by=("conv_id",)).select("conv_id", "cell_no", "symbol_name", "start_line", "end_line", F.md5("text").alias("text_md5"))
