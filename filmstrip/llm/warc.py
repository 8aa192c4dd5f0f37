"""WARC archives: written by Spark's text writer, read by boundary-chain verification.

A record ends with two empty lines, which is the text writer's line separator here, so
archives are written by Spark's own committers and survive lost executors.

Archives are read in ranges of bytes. Each task takes every ``WARC/`` at the start of a
line in its range for a possible record and computes, from the record's Content-Length,
where its successor would start. Within a range these pointers are followed at once, so
a candidate points to the first place behind the range that its chain leads to. Pointer
jumping from each file's start then doubles the reach round by round; only candidates
that the chain from offset 0 arrives at are records. A ``WARC/`` inside a payload is
never reached. Payloads are read in a second pass, from each range's one true entry.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged

BREAK = "\r\n\r\n"
#: Bytes of a range, bytes read for a header (and more where it is longer), and bytes
#: of records in one batch.
RANGE, HEAD, BATCH = 8 << 20, 1 << 16, 8 << 20
#: Payload bytes from which equal payloads are stored once.
REVISIT = 100
#: Parts that the copies of one payload are spread over.
SALTS = 32


def _phrases(pages: DataFrame) -> bytes:
    """Beginnings of a few payloads, which compressed ones then only refer to."""
    few = pages.where(F.octet_length("html") > 0).select(F.substring("html", 1, 2000).alias("html")).limit(16).collect()
    return b"".join(r.html.encode() for r in few)[-(1 << 15) :]


def _squeezed(phrases: bytes):
    def squeeze(batches):
        """Payloads compressed one by one, so that shuffling them takes less room."""
        for batch in batches:
            html = []
            for x in batch.column("html"):
                c = zlib.compressobj(3, wbits=-15, zdict=phrases)
                html.append(c.compress(x.as_buffer()) + c.flush())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(html, pa.binary())], names=batch.schema.names)

    return squeeze


def _texts(phrases: bytes):
    def texts(batches):
        """Head, and behind it the payload where there is to be one."""
        for batch in batches:
            out, held = [], 0
            for head, n, html in zip(batch.column("head"), batch.column("stored"), batch.column("html")):
                payload = zlib.decompressobj(-15, zdict=phrases).decompress(html.as_buffer()).decode() if n.as_py() else ""
                out.append(head.as_py() + BREAK + payload)
                held += len(head.as_py()) + len(payload)
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return texts


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least: int = REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row of ``pages``, all of the same ``date``. A record's id is
    a UUID made of the row's id and its payload's digest.

    Null payloads are empty. Of equal payloads of ``least`` bytes or more the row with
    the smallest id is a response and the others are revisits that refer to it; rows
    that repeat that id are responses too. Rows with a null id have none and
    are responses. Line breaks in urls become blanks."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.regexp_replace(url_col, r"[\r\n]", " "), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html"))
    keys = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).where(F.octet_length("html") >= least)
    firsts = keys.groupBy(F.sha2("html", 256).alias("digest")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("digest", "first")
    # copies of one payload are spread by their ids, and payloads too short to be shared
    # (all empty ones have one digest) each have a key of their own
    names = ["id", "url", "digest", "bytes", "html"]
    kinds = dict(rows.dtypes) | {"html": "binary"}
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    alone = F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))
    phrases = _phrases(rows)
    rows = rows.select(*names).mapInArrow(_squeezed(phrases), ", ".join(f"{n} {kinds[n]}" for n in names))
    rows = rows.withColumns({"key": F.when(F.col("bytes") >= least, F.col("digest")).otherwise(alone), "salt": salt})
    each = firsts.select(F.col("digest").alias("key"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.join(each, ["key", "salt"], "left")
    again = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    hashed = lambda c: F.md5(F.concat_ws(" ", F.coalesce(c.cast("string"), F.lit("null")), F.col("digest"), F.when(c.isNull(), F.col("url"))))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hashed(c), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-5$3-8$4-$5"), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("Page-ID", F.col("id").cast("string")), F.lit("")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(again, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first"))), line("Refers-To-Page", F.col("first").cast("string")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "),
        F.when(again, 0).otherwise(F.col("bytes")).cast("string"),
    )
    stored = F.when(again, 0).otherwise(F.col("bytes")).alias("stored")
    rows.select(head.alias("head"), stored, "html").mapInArrow(_texts(phrases), "value string").write.option("lineSep", BREAK).text(path)


def _opened(path: str):
    """A file of any store that pyarrow reads, by Hadoop's name for it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(name)


_MAGIC = re.compile(rb"WARC/\d\.\d\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.I)


def _blank(f, data: bytes, at: int) -> tuple[bytes, int]:
    """``data`` with as much more of ``f`` as it takes to find the first empty line
    from ``at`` on, and where that is; -1 if there is none up to the file's end."""
    end = data.find(b"\r\n\r\n", at)
    while end < 0:
        more = f.read(max(HEAD, len(data)))
        if not more:
            break
        seen = max(at, len(data) - 3)
        data += more
        end = data.find(b"\r\n\r\n", seen)
    return data, end


def _candidates(f, base: int, size: int) -> list[tuple[int, int]]:
    """(offset, successor's offset) of what looks like a record and starts in the
    ``size`` bytes of ``f`` from ``base`` on."""
    f.seek(base)
    data = first = f.read(size + HEAD)
    out, end, length, looked = [], -1, None, -1
    for m in _MAGIC.finditer(first):
        if m.start() >= size:
            break
        if end < m.start():
            data, end = _blank(f, data, m.start())
            if end < 0:
                break
        if looked != end or (length and length.start() < m.start()):  # else it's the same for this one
            length, looked = _LENGTH.search(data, m.start(), end + 2), end
        if length:
            out.append((base + m.start(), base + end + 4 + int(length[1]) + 4))
    return out


def _edges(batches):
    for batch in batches:
        for number, path, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            with _opened(path) as f:
                found = _candidates(f, low, high - low)
            out = dict(found)
            for at, after in reversed(found):  # the successor's own way out is known
                out[at] = out.get(after, after)
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(out), pa.int64()), pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.int64())], names=["file", "at", "out"])


def _record(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


_FIELDS = ["path", "offset", "type", "id", "url", "digest", "payload_length", "refers_to", "payload"]
_READ = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("url", pa.string()), ("digest", pa.string()), ("payload_length", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _records(batches):
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for path, at, high in zip(*(c.to_pylist() for c in batch.columns)):
            with _opened(path) as f:
                while at < high:
                    f.seek(at)
                    data, end = _blank(f, f.read(HEAD), 0)
                    h = _record(data[:end])
                    n = int(h.get("content-length", -1))
                    f.seek(at + end + 4)
                    payload = f.read(max(n, 0))
                    if end < 0 or len(payload) != n:  # the file ends within the record
                        break
                    length = h.get("warc-payload-length")
                    rows.append((path, at, h.get("warc-type"), h.get("page-id"), h.get("warc-target-uri"), (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None, int(length) if length else None, h.get("refers-to-page"), payload))
                    at += end + 4 + n + 4
                    held += end + n
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r)) for r in rows], schema=_READ)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r)) for r in rows], schema=_READ)


def read_archives(spark: SparkSession, path: str, *, range_bytes: int = RANGE, whole: bool = True) -> DataFrame:
    """One row per record that the chain from its file's start reaches: path, offset,
    type, id, url, digest, payload_length (of the full payload), refers_to, payload.

    A chain ends where no record follows. Where that is not the file's end, what lies
    behind can't be told from payloads: ValueError, or, if the files need not be
    ``whole``, the complete records before it. Empty files and an empty folder have no
    records. Header fields that are missing are null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").where("length > 0")
    files = staged(files.select(F.xxhash64("path").alias("file"), "path", "length"), "files")
    most = files.agg(F.max("length"), F.sum("length")).first()
    ranges = files.select("file", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("low"), "length")
    ranges = ranges.select("file", "path", "low", F.least(F.col("low") + range_bytes, "length").alias("high"))
    tasks = max(1, math.ceil((most[1] or 0) / range_bytes))
    spread = ranges.repartition(tasks, "path", "low")
    edges = staged(spread.mapInArrow(_edges, "file long, at long, out long"), "edges")
    # only what another range's chain leads to can be on the way: about one row a range
    led = edges.select("file", F.col("out").alias("at")).distinct().union(edges.select("file", F.lit(0).cast("long").alias("at")).distinct())
    jumps = staged(edges.join(led, ["file", "at"], "left_semi"), "jumps")
    reached = jumps.where("at = 0").select("file", "at")
    rounds = math.ceil(math.log2(max(1, math.ceil((most[0] or 1) / range_bytes)))) + 1
    for n in range(rounds):
        reached = staged(reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("out").alias("at"))).distinct(), "reached")
        if n + 1 < rounds:
            further = jumps.select("file", F.col("at").alias("out"), F.col("out").alias("beyond"))
            jumps = staged(jumps.join(further, ["file", "out"], "left").select("file", "at", F.coalesce("beyond", "out").alias("out")), "jumps")
    if whole:
        ends = files.join(reached.groupBy("file").agg(F.max("at").alias("end")), "file", "left").where("end is null or end != length").select("path").limit(1).collect()
        if ends:
            raise ValueError(f"{ends[0][0]} does not end with a whole record")
    entries = reached.join(jumps.select("file", "at"), ["file", "at"], "left_semi")
    entries = entries.withColumn("low", F.col("at") - F.col("at") % range_bytes)
    found = ranges.join(entries.groupBy("file", "low").agg(F.min("at").alias("at")), ["file", "low"]).select("path", "at", "high")
    return found.repartition(tasks, "path", "at").mapInArrow(_records, ", ".join(f"`{n}` {t}" for n, t in zip(_FIELDS, ["string", "long", "string", "string", "string", "string", "long", "string", "binary"])))


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payloads of revisits put back from what they refer to."""
    responses = records.where("type = 'response'").select(F.col("id").alias("refers_to"), "digest", F.col("payload").alias("original")).dropDuplicates(["refers_to", "digest"])
    return records.join(responses, ["refers_to", "digest"], "left").withColumn("payload", F.coalesce("original", "payload")).select(*records.columns)


def round_trip(pages: DataFrame, id_col: str = "page_id", **columns: str) -> DataFrame:
    """Archives ``pages`` in the shared folder and reads the archives back."""
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, **columns)
    return read_archives(pages.sparkSession, path)
