"""Queries over paths and questions: trees, manifests, folders, files, routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..functions import text as X
from ..operators import chunking, intent, manifest
from ..sources import files as S
from ..sources.tables import FILES_SQL, files, table
from .text import FILE_WINDOWS_SQL, TOKENS_SQL

QUERIES, SQL = {}, {}

#: Every turn of a conversation as a question: as it is, or its first words in the forms that questions about files have.
_VALUES = f"""words AS (SELECT conv_id, turn, text, {TOKENS_SQL} AS w FROM conversations),
asked AS (SELECT DISTINCT question FROM (SELECT CASE turn % 6 WHEN 0 THEN text WHEN 1 THEN 'what is in the ' || coalesce(w[1], '') || ' folder?' WHEN 2 THEN 'Files in src' || conv_id % 20 || '/' || coalesce(w[2], '')
  WHEN 3 THEN ['hello!', 'Thanks', 'good morning ?', 'hi there', 'who are you'][CAST(1 + conv_id % 5 AS INTEGER)] WHEN 4 THEN 'project structure of ' || coalesce(w[1], '') || '/'
  ELSE 'open doc_' || conv_id || '.md and ' || coalesce(w[1], '') || '.txt in the readme' END AS question FROM words) WHERE question IS NOT NULL)"""
_EXT = "|".join(sorted(config.TARGET_EXTENSIONS, key=lambda e: (-len(e), e)))
_TARGET = rf"(?i)([\w./\\-]+\.(?:{_EXT}))\b"
_STRUCTURE = ("(?i)" + config.STRUCTURE).replace("'", "''")
_FOLDER = ("(?i)" + config.FOLDER).replace("'", "''")
_GREETING = ("(?i)" + config.GREETING).replace("'", "''")
#: RE2 has no lookahead, so readme before a word for folder goes first.
_README = r"regexp_matches(regexp_replace(trim(question), '(?i)\breadme\s+(?:folder|directory|dir)\b', '', 'g'), '(?i)\breadme\b')"
_MENTIONS = f"(regexp_matches(trim(question), '{_TARGET}') OR {_README})"
_IS_STRUCTURE = f"(trim(question) <> '' AND NOT {_MENTIONS} AND regexp_matches(trim(question), '{_STRUCTURE}'))"
_PATHS = f"{FILES_SQL}, paths AS (SELECT DISTINCT repo_id, rel_path AS path FROM files)"


def _tree_sql(src: str, by: str) -> str:
    """keys(by, key, line) of the paths in ``src``."""
    return f"""parts AS (SELECT {by}, string_split(path, '/') AS s FROM {src}),
keys AS (SELECT DISTINCT {by}, key, repeat('  ', CAST(len(key) AS BIGINT) - 1) || key[len(key)].name AS line FROM (
  SELECT {by}, list_transform(range(1, d + 1), lambda i: {{'isfile': CASE WHEN i < len(s) THEN 0 ELSE 1 END, 'name': s[i] || CASE WHEN i < len(s) THEN '/' ELSE '' END}}) AS key FROM (SELECT *, unnest(range(1, len(s) + 1)) AS d FROM parts)))"""


def _q(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _asked(spark, d):
    w = X.tokens(F.col("text"))
    first, second = (F.coalesce(F.get(w, F.lit(i)), F.lit("")) for i in (0, 1))
    greeting = F.get(F.array(*map(F.lit, ["hello!", "Thanks", "good morning ?", "hi there", "who are you"])), (F.col("conv_id") % 5).cast("int"))
    form = F.col("turn") % 6
    question = (
        F.when(form == 0, F.col("text")).when(form == 1, F.concat(F.lit("what is in the "), first, F.lit(" folder?"))).when(form == 2, F.concat(F.lit("Files in src"), (F.col("conv_id") % 20).cast("string"), F.lit("/"), second))
        .when(form == 3, greeting).when(form == 4, F.concat(F.lit("project structure of "), first, F.lit("/"))).otherwise(F.concat(F.lit("open doc_"), F.col("conv_id").cast("string"), F.lit(".md and "), first, F.lit(".txt in the readme")))
    )
    return table(spark, d, "conversations").select(question.alias("question")).where("question is not null").distinct()


def _paths(spark, d):
    return manifest.distinct_paths(files(spark, d))


@_q("repo_tree", f"WITH {_PATHS}, {_tree_sql('paths', 'repo_id')} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY key) AS line_no, line FROM keys")
def _(spark, d):
    return manifest.tree(_paths(spark, d))


_IN = "(lower(path) = 'src7/en' OR starts_with(lower(path), 'src7/en/'))"


def _folder_sql() -> str:
    return f"""WITH {_PATHS}, n AS (SELECT repo_id, CAST(count(CASE WHEN {_IN} THEN 1 END) AS BIGINT) AS n_files FROM paths GROUP BY 1),
inner_ AS (SELECT repo_id, substr(path, 9) AS path FROM paths WHERE {_IN}), {_tree_sql('inner_', 'repo_id')},
t AS (SELECT repo_id, string_agg(line, chr(10) ORDER BY key) AS text FROM keys GROUP BY 1),
folder AS (SELECT repo_id, n_files, CASE WHEN n_files = 0 THEN '(No indexed files under src7/en/)' ELSE 'src7/en/' || chr(10) || text END AS text FROM n LEFT JOIN t USING (repo_id))"""


@_q("folder_tree", f"{_folder_sql()} SELECT * FROM folder")
def _(spark, d):
    return manifest.folder_text(_paths(spark, d), "src7/en")


_HEAD = "'Repository file index — searchable text files (' || total || ' total):' || chr(10)"


@_q(
    "manifest_chunks",
    f"""WITH {_PATHS}, b AS (SELECT *, (row_number() OVER (PARTITION BY repo_id ORDER BY path) - 1) // 20 AS batch_no, count(*) OVER (PARTITION BY repo_id) AS total FROM paths), {_tree_sql('b', 'repo_id, batch_no')},
t AS (SELECT repo_id, batch_no, string_agg(line, chr(10) ORDER BY key) AS tree, count(*) AS n_lines FROM keys GROUP BY 1, 2), n AS (SELECT repo_id, batch_no, count(*) AS n_paths, max(total) AS total FROM b GROUP BY 1, 2)
SELECT repo_id, batch_no, n_paths, md5({_HEAD} || tree) AS text_md5, n_lines + 1 AS end_line FROM n JOIN t USING (repo_id, batch_no)""",
)
def _(spark, d):
    # twenty paths a chunk, so that every repository has several
    return manifest.manifest_chunks(_paths(spark, d), size=20).select("repo_id", "batch_no", "n_paths", F.md5("text").alias("text_md5"), "end_line")


@_q(
    "skipped_summary",
    """WITH p AS (SELECT 'all' AS repo_id, split_part(split_part(url, '://', 2), '.', 1) AS folder, CASE page_id % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.zip' WHEN 2 THEN '.so' WHEN 3 THEN '.png' ELSE '(no ext)' END AS ext FROM pages),
c AS (SELECT repo_id, folder, ext, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo_id, folder ORDER BY n DESC, ext) AS k FROM c)
SELECT repo_id, folder, CAST(sum(n) AS BIGINT) AS n_files, string_agg(CASE WHEN k <= 4 THEN n || ' ' || ext END, ', ' ORDER BY k) AS ext_parts FROM r GROUP BY 1, 2""",
)
def _(spark, d):
    name = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1))
    ext = F.element_at(F.array(*map(F.lit, [".png", ".zip", ".so", ".png", ""])), (F.col("page_id") % 5 + 1).cast("int"))
    paths = table(spark, d, "pages").select(F.lit("all").alias("repo_id"), F.concat(name, F.lit("/f"), F.col("page_id").cast("string"), ext).alias("rel_path"))
    return S.skipped_summary(paths)


@_q("distinct_paths", f"WITH {_PATHS} SELECT * FROM paths")
def _(spark, d):
    return manifest.distinct_paths(chunking.windows(files(spark, d)).unionByName(chunking.windows(files(spark, d)))).select("repo_id", "path")


@_q("paths_by_top_level", f"WITH {_PATHS} SELECT split_part(path, '/', 1) AS top, count(*) AS n_paths, min(path) AS first_path FROM paths GROUP BY 1")
def _(spark, d):
    return _paths(spark, d).groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("top")).agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path"))


@_q("folder_prefix_filter", f"WITH {_PATHS} SELECT path AS rel_path FROM paths WHERE {_IN}")
def _(spark, d):
    return _paths(spark, d).where(intent.under_prefix(F.col("path"), "\\Src7\\EN/")).select(F.col("path").alias("rel_path"))


_CUE = rf"(?i){config.FOLDER_CUE}"
_PREFIX = f"""p AS (SELECT question, trim(question) AS q, regexp_replace(trim(question), '(?i){config.STRUCTURE_PHRASES}', ' ', 'g') AS s FROM asked),
f AS (SELECT question, trim(regexp_replace(trim(regexp_extract(s, '{_FOLDER}', 1)), '^/+|/+$', '', 'g')) AS name, s <> q AND NOT regexp_matches(q, '{_CUE}') AS whole FROM p),
folder AS (SELECT question, CASE WHEN whole OR name = '' OR lower(name) IN ({', '.join(repr(x) for x in config.NOT_FOLDERS)}) OR contains(regexp_extract(name, '([^/]*)$', 1), '.') THEN NULL ELSE name END AS folder FROM f)"""


@_q("folder_prefix_extract", f"WITH {_VALUES}, {_PREFIX} SELECT * FROM folder")
def _(spark, d):
    return _asked(spark, d).select("question", intent.folder_prefix(F.col("question")).alias("folder"))


_TARGETS = f"""names AS (SELECT question, list_concat(list_transform(regexp_extract_all(trim(question), '{_TARGET}', 1), lambda x: lower(x)), CASE WHEN {_README} THEN ['readme'] ELSE [] END) AS names FROM asked),
cand AS (SELECT question, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM names),
hit AS (SELECT question, pos, 0 AS rule, path FROM cand JOIN paths ON lower(path) = name
  UNION ALL SELECT question, pos, 1, max(path) FROM cand JOIN paths ON regexp_extract(lower(path), '([^/]*)$', 1) = regexp_extract(name, '([^/]*)$', 1) GROUP BY 1, 2
  UNION ALL SELECT question, pos, 2, min(path) FROM cand JOIN paths ON ends_with(lower(path), '/' || name) GROUP BY 1, 2),
target AS (SELECT question, path AS target FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY pos, rule) AS k FROM hit) WHERE k = 1)"""


@_q("file_target_match", f"WITH {_VALUES}, {_PATHS}, {_TARGETS} SELECT * FROM target")
def _(spark, d):
    return intent.target_files(_asked(spark, d), _paths(spark, d), path="path")


@_q("file_target_chunks", f"WITH {FILE_WINDOWS_SQL} SELECT rel_path, start_line, 1.0::DOUBLE AS score FROM windows WHERE regexp_extract(lower(rel_path), '([^/]*)$', 1) = 'doc_12.md'")
def _(spark, d):
    w = chunking.windows(files(spark, d))
    return w.where(S.basename(F.lower("rel_path")) == "doc_12.md").select("rel_path", "start_line", F.lit(1.0).alias("score"))


@_q("structure_listing", f"{_folder_sql()}, s AS (SELECT repo_id, 'Indexed files under src7/en/ (' || n_files || ' file(s)):' || chr(10) || text AS text, n_files FROM folder) SELECT *, len(string_split(text, chr(10))) AS end_line FROM s")
def _(spark, d):
    return manifest.structure_listing(_paths(spark, d), "src7/en")


@_q("structure_query_filter", f"WITH {_VALUES} SELECT question, {_IS_STRUCTURE} AS is_structure FROM asked")
def _(spark, d):
    return _asked(spark, d).select("question", intent.is_structure(F.col("question")).alias("is_structure"))


@_q("conversational_filter", f"WITH {_VALUES} SELECT question, regexp_matches(trim(question), '{_GREETING}') AS is_conversational FROM asked")
def _(spark, d):
    return _asked(spark, d).select("question", intent.is_conversational(F.col("question")).alias("is_conversational"))


@_q(
    "query_route",
    f"""WITH {_VALUES}, {_PATHS}, {_TARGETS}, sizes AS (SELECT unnest([10, 50, 51])::BIGINT AS corpus_size)
SELECT question, corpus_size, CASE WHEN regexp_matches(trim(question), '{_GREETING}') THEN 'conversational' WHEN target IS NOT NULL THEN 'file' WHEN {_IS_STRUCTURE} THEN 'structure' WHEN corpus_size <= 50 THEN 'whole' ELSE 'full' END AS route
FROM asked LEFT JOIN target USING (question), sizes""",
)
def _(spark, d):
    found = _asked(spark, d).join(intent.target_files(_asked(spark, d), _paths(spark, d), path="path"), "question", "left")
    sized = found.withColumn("corpus_size", F.explode(F.array(*(F.lit(n).cast("long") for n in (10, 50, 51)))))
    return sized.select("question", "corpus_size", intent.route(F.col("question"), F.col("target").isNotNull(), F.col("corpus_size")).alias("route"))


@_q("overview_sort", f"WITH {FILE_WINDOWS_SQL} SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY contains(lower(rel_path), 'readme') DESC, lower(rel_path), start_line) AS rank, rel_path, start_line FROM windows")
def _(spark, d):
    from pyspark.sql import Window

    w = chunking.windows(files(spark, d))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(*manifest.overview_rank(F.col("rel_path")), "start_line"))
    return w.select("repo_id", rank.cast("long").alias("rank"), "rel_path", "start_line")
