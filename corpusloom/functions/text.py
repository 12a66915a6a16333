"""Scalar functions over text, URLs and vectors, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once a row.

    A column that a lambda refers to may be replaced by its expression when a filter moves below a projection, and
    is then worked out for every element; a lambda's own variable never is.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: White space by its code points, which is quicker than by its property. Fixed value.
_SPACE = r"[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def tokens(text: Column) -> Column:
    """Lower-case words at any white space, Unicode's and the ASCII separators included."""
    return F.array_remove(F.split(F.lower(text), _SPACE), "")


def token_count(text: Column) -> Column:
    """Tokens at four characters each, rounded up: the default of the pluggable counter."""
    return F.ceil(F.length(text) / 4).cast("long")


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")


def embed_text(path: Column, text: Column) -> Column:
    """The text that is embedded and hashed: led by its path, unless it is a manifest or has none."""
    bare = (F.coalesce(path, F.lit("")) == "") | F.startswith(path, F.lit(config.MANIFEST_PREFIX))
    return F.when(bare, text).otherwise(F.concat(F.lit("File: "), path, F.lit("\n"), text))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def embed_prompt(text: Column, model: str, task: str) -> Column:
    """Clipped, blank texts as one blank; the prefix of models that want one comes after the clip."""
    body = F.when(F.rlike(text, F.lit(r"(?U)\S")), F.left(text, F.lit(config.EMBED_TEXT_CHARS))).otherwise(" ")
    return F.concat(F.lit(f"search_{task}: "), body) if "nomic-embed" in model.lower() else body


def normalize_url(url: Column) -> Column:
    return F.regexp_replace(F.rtrim(F.trim(url), F.lit("/")), r"(?i)\.git$", "")


def repo_id(url: Column) -> Column:
    return F.left(F.md5(url), F.lit(8))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def admitted_url(url: Column, hosts: list[str] | None = None) -> Column:
    return F.startswith(F.lower(url), F.lit("https://")) & url_host(url).isin(hosts or config.URL_HOSTS)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """A unit vector; zero stays zero."""
    return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def keyword_rate(answer: Column, keywords: Column) -> Column:
    """Share of keywords that the answer contains, without case; 1 without keywords."""
    hit = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(hit / F.size(keywords))
