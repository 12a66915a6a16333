"""WARC archives: written from pages, read record by record, and assembled into one nested row a capture.

Writing: every page becomes a transaction of three records - its request, its response (or a revisit, if another page
has the same payload), and metadata with the page's id - that name each other by WARC-Concurrent-To.  Records go through
Spark's text writer, whose line separator is the blank lines that end a record, into gzip files.

Reading: Spark's text reader cuts the files where a record's end is followed by the next one's version line, and a
reader over each file's pieces puts those together again that a payload's own bytes have cut, by Content-Length; memory
follows the longest record.  A gzip file is read by one task, as any gzip file, so archives should come in many files.
A file that isn't compressed may be split; a record that would be cut both by its own bytes and by the end of a split is
an error that asks for gzip.

Assembly: an index of the records without their payloads is joined - requests and metadata to the response, revisit or
resource that they are concurrent to, whichever of the two names the other - into one row a capture.  Revisits are
resolved by payload digest, the profile that they are written with.  No payload is shuffled.

Defined cases: a null payload is an empty one; a null url leaves WARC-Target-URI out; line ends in a url are written as
%0D and %0A; a null id leaves its metadata field out and is smaller than all others; rows that share the largest id and
the payload are all responses; equal rows are separate captures; payloads of under ``min_bytes`` are never revisits; an
empty table gives no archive rows and no captures.  If several requests or metadata records belong to one capture, the
one with the smallest record id is taken and their numbers are told.  A record without Content-Length is an error.
Columns of the pages other than the three that are named are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import reach, shared_folder

END = "\r\n\r\n"
NEXT = "WARC/1."
#: Payloads with copies that are sent to all tasks, at about 100 bytes each; beyond it they are joined by shuffle.
BROADCAST = 1 << 18
SALTS = 32


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: str, block: Column, fields: dict[str, Column]) -> Column:
    """A record without the blank lines that end it; fields that are null are left out."""
    named = {"WARC-Type": F.lit(kind), **fields, "Content-Length": F.octet_length(block).cast("string")}
    lines = [F.concat(F.lit(f"{k}: "), v) for k, v in named.items()]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines), F.lit(END), block)


def _salted(rows: DataFrame, small: DataFrame, on: str, salt: Column) -> DataFrame:
    """Left join of rows whose keys may be hot: each key of ``small`` is there once for each salt."""
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("_salt")
    return rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)).cast("int")).join(small.select("*", salts), [on, "_salt"], "left").drop("_salt")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archives of ``pages`` in gzip files below ``path``, as many as the pages have partitions.

    Of pages whose payloads of at least ``min_bytes`` are equal, that with the largest ``key`` is a response, all
    others are revisits.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), text.alias("text")).withColumns({"digest": base32_sha1(F.col("text")), "n_bytes": F.octet_length("text")})
    copies = rows.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first", F.lit(True).alias("copied"))
    copies.write.parquet(f"{path}-copies")
    copies = spark.read.parquet(f"{path}-copies")
    number = F.monotonically_increasing_id()
    rows = rows.withColumn("number", number)
    rows = rows.join(F.broadcast(copies), "digest", "left") if copies.count() <= BROADCAST else _salted(rows, copies, "digest", F.xxhash64("number"))

    of = lambda kind: _urn(F.lit(kind), F.col("key").cast("string"), F.col("url"), F.col("digest"), F.col("number").cast("string"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    common = {"WARC-Date": F.lit(date), "WARC-Target-URI": target}
    reply = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    main = {"WARC-Record-ID": of("response"), **common, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"), "Content-Type": F.lit("application/http; msgtype=response")}
    host, rest = F.regexp_extract(target, r"^[^:]*://([^/?#]*)", 1), F.regexp_extract(target, r"^[^:]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(F.coalesce(rest, F.lit("")) == "", "/").otherwise(rest), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END))
    revisit = F.coalesce("copied", F.lit(False)) & ~F.col("key").eqNullSafe(F.col("first"))
    records = F.array(
        _record("request", asked, {"WARC-Record-ID": of("request"), **common, "WARC-Concurrent-To": of("response"), "Content-Type": F.lit("application/http; msgtype=request")}),
        F.when(revisit, _record("revisit", reply, main | {"WARC-Profile": F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")})).otherwise(_record("response", F.concat(reply, "text"), main)),
        _record("metadata", F.concat_ws("", F.concat(F.lit(f"{key}: "), F.col("key").cast("string"), F.lit("\r\n"))), {"WARC-Record-ID": of("metadata"), **common, "WARC-Concurrent-To": of("response"), "Content-Type": F.lit("application/warc-fields")}),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Names, in lower case, and values of a header's lines; a line that begins with white space goes on with the last."""
    out: list[list[str]] = []
    for line in head.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and out:
            out[-1][1] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            name, value = line.split(b":", 1)
            out.append([name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")])
    return [(k, v) for k, v in out]


def whole_records(pieces: Iterator[tuple[str, int, bytes]]) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(fields, block) of each record from (file, start of the split, piece) in the order of reading."""
    cut = (END + NEXT).encode()
    place, fields, block, need = None, None, [], 0

    def broken():
        return ValueError(f"{place[0]}: a record ends before its Content-Length" + (", at a split of the file; compress it with gzip" if place[1] else ""))

    for file, start, piece in pieces:
        if (file, start) != place:
            if fields is not None:
                raise broken()
            place, first = (file, start), start == 0
            if first and piece.strip() and not piece.startswith(NEXT.encode()):
                raise ValueError(f"{file}: no WARC/1 record at its beginning")
        while piece is not None:
            if fields is None:
                if not piece.strip():  # an empty file, or blank lines at its end
                    break
                head, sep, body = piece.partition(END.encode())
                fields = _fields(head.split(b"\r\n", 1)[-1])
                length = dict(fields).get("content-length", "")
                if not sep or not length.isdigit():
                    raise ValueError(f"{file}: a record without Content-Length")
                block, need = [body], int(length) - len(body)
            else:  # the separator was part of the block
                block += [cut, piece]
                need -= len(cut) + len(piece)
            piece = None
            if need <= 0:
                body = b"".join(block)
                if need < 0:
                    body, rest = body[:need], body[need:]
                    if rest.startswith(cut):  # a separator that the reader took for part of a line
                        piece = rest[len(cut) :]
                    elif rest.strip(b"\r\n"):
                        raise ValueError(f"{file}: a record goes on beyond its Content-Length")
                yield fields, body
                fields = None
    if fields is not None:
        raise broken()


_TEXT = T.StringType()
RECORD = T.StructType(
    [T.StructField(c, _TEXT) for c in ("type", "record_id", "target_uri", "date", "declared_digest", "content_type")]
    + [T.StructField("concurrent_to", T.ArrayType(_TEXT)), T.StructField("headers", T.MapType(_TEXT, _TEXT)), T.StructField("http_head", _TEXT), T.StructField("payload", T.BinaryType())]
)


def _row(fields: list[tuple[str, str]], block: bytes) -> tuple:
    named = dict(fields)
    head, payload = None, block
    if named.get("content-type", "").startswith("application/http"):
        raw, _, payload = block.partition(END.encode())
        head = raw.decode("utf-8", "replace")
    digest = named.get("warc-payload-digest")
    return (
        named.get("warc-type"), named.get("warc-record-id"), named.get("warc-target-uri"), named.get("warc-date"), digest.split(":", 1)[-1] if digest else None, named.get("content-type"),
        [v for k, v in fields if k == "warc-concurrent-to"], list(named.items()), head, payload,
    )


def read(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """Every record below ``path``: the columns of ``RECORD``; of HTTP blocks the head and the payload are apart."""
    reach(spark)
    pieces = spark.read.option("lineSep", END + NEXT).text(path).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    types = [pa.string()] * 6 + [pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=RECORD.names)

    def run(batches):
        each = ((f, s, p) for b in batches for f, s, p in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), (x.as_py() for x in b.column("piece")), strict=True))
        rows, held = [], 0
        for fields, block in whole_records(each):
            rows.append(_row(fields, block))
            held += len(block)
            if held > batch_bytes or len(rows) == 4096:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    return pieces.mapInArrow(run, RECORD)


def index(records: DataFrame) -> DataFrame:
    """``records`` without payloads: their length and digest instead, and the fields of metadata blocks."""
    listed = F.when(F.col("type") == "metadata", F.str_to_map(F.regexp_replace(F.col("payload").cast("string"), r"[\r\n]+$", ""), F.lit("\r\n"), F.lit(": ")))
    return records.select(*(c for c in RECORD.names if c != "payload"), F.length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("digest"), listed.alias("fields"))


def assemble(entries: DataFrame) -> DataFrame:
    """One row a response, revisit or resource of an ``index``: capture, with request and metadata as structs in it.

    A request or metadata record belongs to a capture that it names as concurrent, or that names it, or that names the
    same record as it does.
    """
    main = entries.where(F.col("type").isin("response", "revisit", "resource"))
    names = main.select(F.col("record_id").alias("main"), F.explode(F.array_distinct(F.concat(F.array("record_id"), "concurrent_to"))).alias("id")).where("id is not null")
    out = main.withColumn("main", F.col("record_id"))
    for kind in ("request", "metadata"):
        side = F.struct("record_id", "target_uri", "http_head", "fields", "headers")
        own = entries.where(F.col("type") == kind).select(F.explode(F.array_distinct(F.concat(F.array("record_id"), "concurrent_to"))).alias("id"), "record_id", side.alias("side")).where("id is not null")
        found = own.join(names, "id").groupBy("main").agg(F.min_by("side", "record_id").alias(kind), F.count_distinct("record_id").alias(f"n_{kind}"))
        out = out.join(found, "main", "left").withColumn(f"n_{kind}", F.coalesce(f"n_{kind}", F.lit(0)).cast("long"))
    reply = F.struct("record_id", "type", "target_uri", "date", "http_head", "declared_digest", "digest", "n_bytes", "headers")
    return out.select(F.struct(reply.alias("reply"), "request", "n_request", "metadata", "n_metadata").alias("capture"))


def captures(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Captures of the archives below ``path``, with the payload of the reply if asked for."""
    out = assemble(indexed(spark, path))
    if not payload:
        return out
    bodies = read(spark, path).where(F.col("type").isin("response", "resource")).select("record_id", "payload")
    return out.withColumn("record_id", F.col("capture.reply.record_id")).join(bodies, "record_id", "left").drop("record_id")


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """The index of the archives below ``path``, written beside them once and read by the joins."""
    at = f"{path}-index-{uuid.uuid4().hex}"
    index(read(spark, path)).write.parquet(at)
    return spark.read.parquet(at)


def resolved(rows: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` (``key``, type, record_id, declared_digest, digest, n_bytes) with the digest and length of the full payload, and for revisits refers_to, the largest ``key`` of a response with it."""
    revisits = rows.where("type = 'revisit'").select("record_id", F.col("declared_digest").alias("full"), F.col(key).alias("own"))
    wanted = revisits.select("full").distinct()
    known = rows.where("type <> 'revisit'").groupBy(F.col("digest").alias("full")).agg(F.max(key).alias("refers_to"), F.max("n_bytes").alias("full_bytes")).join(wanted, "full", "left_semi")
    back = _salted(revisits, known, "full", F.xxhash64("record_id"))
    direct = rows.where("type <> 'revisit'").select(F.col(key), "type", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit(None).cast(rows.schema[key].dataType).alias("refers_to"))
    return direct.unionByName(back.select(F.col("own").alias(key), F.lit("revisit").alias("type"), F.col("full_bytes").alias("payload_bytes"), F.col("full").alias("payload_digest"), "refers_to"))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    own = F.col("capture.metadata.fields")["page_id"].cast("long").alias("page_id")
    rows = captures(spark, path).select(own, "capture.reply.type", "capture.reply.record_id", "capture.reply.declared_digest", "capture.reply.digest", "capture.reply.n_bytes")
    return resolved(rows, "page_id").select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
