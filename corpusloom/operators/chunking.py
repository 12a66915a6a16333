"""Chunks: overlapping line windows with caps, notebook cells, and Python or brace-language definitions."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.text import line_count, token_count
from ..sources.files import basename, suffix


def window_cap(path: Column) -> Column:
    """Windows that a file may have by its kind; 0 is no cap. Unknown kinds count as HTML."""
    ext = suffix(path)
    return (
        F.when(ext.isin(config.HTML_EXTENSIONS), config.HTML_WINDOW_CAP)
        .when(ext.isin(config.DOC_EXTENSIONS) | (F.lower(basename(path)) == "readme"), config.DOC_WINDOW_CAP)
        .when(ext.isin(config.CODE_EXTENSIONS), config.CODE_WINDOW_CAP)
        .otherwise(config.HTML_WINDOW_CAP)
    )


def windows(files: DataFrame, text: str = "text", caps: list[Column | int] | None = None, size: int = config.WINDOW_LINES, stride: int = config.STRIDE_LINES) -> DataFrame:
    """``files`` with chunk_no, start_line, end_line and text of each window that isn't blank.

    All of a file's windows are cut in its own row, so no shuffle is needed; ``caps`` (0: none) count windows that aren't blank.
    """
    lines = F.split(F.col(text), "\n")
    n = F.size("_lines")
    cut = F.transform(
        F.sequence(F.lit(0), F.ceil(n / stride).cast("int") - 1),
        lambda i: F.struct(
            i.cast("long").alias("chunk_no"),
            (i * stride + 1).cast("long").alias("start_line"),
            F.least(i * stride + size, n).cast("long").alias("end_line"),
            F.array_join(F.slice("_lines", i * stride + 1, F.lit(size)), "\n").alias("text"),
        ),
    )
    kept = F.filter(cut, lambda w: w["text"].rlike(r"(?U)\S"))
    for cap in caps or []:
        cap = F.lit(cap) if isinstance(cap, int) else cap
        kept = F.when(cap > 0, F.slice(kept, F.lit(1), F.greatest(cap, F.lit(1)))).otherwise(kept)
    others = [c for c in files.columns if c != text]
    return files.withColumn("_lines", lines).where(F.col("_lines").isNotNull()).select(*others, F.explode(kept).alias("_w")).select(*others, "_w.*")


def notebook_cells(cells: DataFrame, text: str, kind: Column, number: Column, by: list[str]) -> DataFrame:
    """Cells of code and Markdown as chunks; longer ones than the token limit as windows that start at the cell's number.

    ``number`` counts a notebook's cells from 1; cells beyond the notebook limit and blank ones are left out.
    """
    body = F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", "")
    rows = cells.select(*by, number.cast("long").alias("cell_no"), kind.alias("cell_type"), body.alias("text"))
    rows = rows.where(F.col("cell_type").isin("code", "markdown") & (F.col("text") != "") & (F.col("cell_no") <= config.NOTEBOOK_MAX_CELLS))
    rows = rows.withColumns({
        "language": F.when(F.col("cell_type") == "code", "python").otherwise("markdown"),
        "symbol_name": F.concat_ws("_", F.lit("cell"), F.col("cell_no").cast("string"), "cell_type"),
    })
    long = token_count(F.col("text")) > config.CHUNK_TOKEN_LIMIT
    short = rows.where(~long).withColumns({"start_line": F.col("cell_no"), "end_line": F.col("cell_no") - 1 + line_count(F.col("text"))})
    parts = windows(rows.where(long)).withColumn("end_line", F.col("cell_no") + F.col("end_line") - F.col("start_line")).withColumn("start_line", F.col("cell_no"))
    return short.unionByName(parts.drop("chunk_no"))


def notebook_chunks(notebooks: DataFrame, text: str = "text", by: tuple[str, ...] = ("repo_id", "rel_path")) -> DataFrame:
    """The cells of notebooks in JSON as chunks: a cell's ``source`` may be a text or a list of texts.

    What isn't a cell counts in the numbering and is left out; a text that is no JSON, or has no list of cells, has none.
    """
    cells = F.try_variant_get(F.try_parse_json(F.col(text)), "$.cells", "array<variant>")
    rows = notebooks.select(*by, F.posexplode(cells).alias("i", "cell"))
    source = F.try_variant_get("cell", "$.source", "variant")
    body = F.when(F.schema_of_variant(source) == "STRING", F.try_variant_get("cell", "$.source", "string")).otherwise(F.array_join(F.try_variant_get("cell", "$.source", "array<string>"), ""))
    return notebook_cells(rows.select(*by, "i", F.try_variant_get("cell", "$.cell_type", "string").alias("k"), body.alias("text")), "text", F.col("k"), F.col("i") + 1, list(by))


CHUNK = T.StructType([T.StructField("chunk_type", T.StringType()), T.StructField("symbol_name", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("text", T.StringType())])


def _spans(first: int, last: int) -> Iterator[tuple[int, int]]:
    for i in range(first, last + 1, config.STRIDE_LINES):
        yield i, min(i + config.WINDOW_LINES - 1, last)


def _emit(lines: list[str], first: int, last: int, kind: str, name: str, tokens) -> Iterator[tuple]:
    """One chunk, or windows of it if it is too long."""
    text = "\n".join(lines[first - 1 : last])
    parts = [(first, last)] if tokens(text) <= config.CHUNK_TOKEN_LIMIT else list(_spans(first, last))[: config.MAX_CHUNKS_PER_FILE]
    for a, b in parts:
        body = "\n".join(lines[a - 1 : b])
        if body.strip():
            yield kind, name, a, b, body


def _python(source: str, tokens) -> Iterator[tuple]:
    lines = source.split("\n")

    def visit(body) -> Iterator[tuple]:
        for node in body:
            if isinstance(node, ast.If):
                text = ast.get_source_segment(source, node.test) or ""
                if "__name__" in text and "__main__" in text:
                    yield from _emit(lines, node.lineno, node.end_lineno, "main_guard", "__main__", tokens)
                    continue
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                kind = "decorated_definition" if node.decorator_list else "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
                if isinstance(node, ast.ClassDef) and tokens("\n".join(lines[first - 1 : node.end_lineno])) <= config.CHUNK_TOKEN_LIMIT:
                    yield from visit(node.body)  # a short class is its members
                else:
                    yield from _emit(lines, first, node.end_lineno, kind, node.name, tokens)
            else:
                for name in ("body", "orelse", "finalbody"):
                    inner = getattr(node, name, None)
                    if isinstance(inner, list):
                        yield from visit(inner)

    yield from visit(ast.parse(source).body)


#: What opens a definition in a language of braces: chunk type, whether it is recursed into, pattern with the name.
_BRACES = {
    "javascript": [("class_declaration", True, r"\bclass\s+(\w+)"), ("function_declaration", False, r"\bfunction\s*\*?\s*(\w+)\s*\("), ("arrow_function", False, r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>")],
    "java": [("class_declaration", True, r"\bclass\s+(\w+)"), ("method_declaration", False, r"(?m)^\s*(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ]+\s+(\w+)\s*\([^;{}]*\)\s*(?:throws [\w, .]+)?(?=\{)")],
    "go": [("method_declaration", False, r"\bfunc\s+\([^)]*\)\s*(\w+)\s*\("), ("function_declaration", False, r"\bfunc\s+(\w+)\s*\(")],
    "rust": [("impl_item", True, r"\bimpl\b(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)"), ("function_item", False, r"\bfn\s+(\w+)")],
}
_BRACES["typescript"] = _BRACES["javascript"]
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)


def _braces(source: str, language: str, tokens) -> Iterator[tuple]:
    lines = source.split("\n")
    # strings and comments keep their length and lines, not their characters
    plain = _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), source)

    # each opening brace's end, in one pass; one that is never closed lasts to the end
    ends, depth = {}, []
    for b in re.finditer(r"[{}]", plain):
        if b.group() == "{":
            depth.append(b.start())
        elif depth:
            ends[depth.pop()] = b.start()

    def visit(lo: int, hi: int) -> Iterator[tuple]:
        at, ahead = lo, {}
        while True:
            for _, _, p in _BRACES[language]:
                # a pattern is searched again only when its hit has been passed
                if p not in ahead or (ahead[p] and ahead[p].start() < at):
                    ahead[p] = re.compile(p).search(plain, at, hi)
            hits = [(m.start(), m, kind, deep) for kind, deep, p in _BRACES[language] if (m := ahead[p])]
            if not hits:
                return
            _, m, kind, deep = min(hits, key=lambda h: h[0])
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            opened = plain.find("{", m.end(), hi)
            end = ends.get(opened, len(plain) - 1) if opened >= 0 else plain.find("\n", m.end(), hi)
            end = hi - 1 if end < 0 else end
            first, last = source.count("\n", 0, begin) + 1, source.count("\n", 0, end) + 1
            if deep and opened >= 0 and tokens("\n".join(lines[first - 1 : last])) <= config.CHUNK_TOKEN_LIMIT:
                yield from visit(opened + 1, end)
            else:
                yield from _emit(lines, first, last, kind, m.group(1), tokens)
            at = end + 1

    yield from visit(0, len(plain))


def code_chunks_of(source: str, language: str, tokens=lambda t: -(-len(t) // 4)) -> list[tuple]:
    """(chunk_type, symbol, first line, last line, text); line windows where a source can't be parsed or defines nothing."""
    if language not in {*_BRACES, "python", "markdown", "plaintext"}:
        raise ValueError(f"no chunker for {language}")
    found: list[tuple] = []
    try:
        if language == "python":
            found = list(_python(source, tokens))
        elif language in _BRACES:
            found = list(_braces(source, language, tokens))
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # the parser's own stack ends in a MemoryError
        found = []
    if found:
        return found
    lines = source.split("\n")
    cap = config.CODE_WINDOW_CAP if language in {*_BRACES, "python"} else config.MAX_CHUNKS_PER_FILE
    parts = [("sliding_window", "", a, b, "\n".join(lines[a - 1 : b])) for a, b in _spans(1, len(lines))]
    return [p for p in parts if p[-1].strip()][:cap]


def code_chunks(files: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """``files`` (less the text) with the chunks of each source; sources go to Python by Arrow batches."""
    keep = [c for c in files.columns if c not in (text, *CHUNK.names)]
    schema = T.StructType([*(files.schema[c] for c in keep), *CHUNK.fields])

    def run(frames):
        import pandas as pd

        for pdf in frames:
            rows = [(*own, *chunk) for *own, source, lang in pdf[[*keep, text, language]].itertuples(index=False) if source is not None for chunk in code_chunks_of(source, lang)]
            yield pd.DataFrame(rows, columns=schema.names)

    return files.mapInPandas(run, schema)
