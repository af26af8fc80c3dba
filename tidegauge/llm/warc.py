"""WARC archives: written as one gzip stream a file, normalised to one member a record with an offset index, and read back.

``write_archives`` writes the rows of a table as WARC records. Among records with equal payloads of at least ``least`` bytes the one
with the largest id is a response, the others revisit it and hold only its HTTP head. Each file is one gzip stream over all its
records, as crawlers that compress afterwards leave them: no record can be reached without inflating all before it.

``normalise`` mends that. Each file is inflated once, as a stream; each record is written as a gzip member of its own, and beside each
file of members stands a sidecar index with the offset and length of every one. Both come from one pass and one write job, whose
committer replaces lost or repeated tasks' files as a whole. The sink of raw bytes is Spark's text sink: it ends each value
with a fixed separator, which here is a gzip member without content, so a file of members is one valid gzip file, in any store Spark writes to.

``read_records`` reads the members a sidecar lists, member by member, each inflated by itself.

Defined results: a null payload counts as empty; a null id is written as an empty one and read back as null, and is smaller than any other; rows
that repeat the largest id of their payload are all responses; a payload of any length and bytes is kept as it is, also one that holds
the marks of a record; control characters and spaces in a url become ``%20``, a null url has no header. An empty table gives no
records. A file that ends early or is damaged keeps its whole records; the sidecar says where it broke. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.core.session import drop_path, scratch_path

RECORD_END = "\r\n\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
ID = "urn:x-row:"
FILE_ROWS = 20_000  # records of one archive at most
HEAVY = 64
PIECE = 1 << 18  # compressed bytes inflated at a time
_WRITTEN = "kind string, nth bigint, value binary"
_RECORDS = "file string, offset bigint, length bigint, record_type string, id string, uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, by tens of hexadecimal digits: 40 bits are eight base32 digits."""
    h = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*part)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_responses(rows: DataFrame, least: int = 0) -> DataFrame:
    """(id, url, payload) with ``refers_to``, the id of the response that a revisit repeats; null for a response.

    Payloads are equal when length and SHA-256 are. A payload that holds more than one part in HEAVY of all rows is one of fewer
    than HEAVY, which are broadcast; the other repeated payloads are joined by their digest.
    """
    key = F.struct(F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("sha"))
    keyed = rows.withColumn("key", key)
    folder = scratch_path(rows.sparkSession, "payloads")
    long = keyed.where(F.col("key.bytes") >= least)
    long.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.max("id").alias("kept")).write.parquet(folder)
    groups = rows.sparkSession.read.parquet(folder)
    total = groups.agg(F.sum("copies")).first()[0] or 0
    twice = groups.where("copies > 1")
    heavy = F.broadcast(twice.where(F.col("copies") * HEAVY > total).select("key", "kept", F.lit(True).alias("hot")))  # fewer than HEAVY rows
    marked = keyed.join(heavy, "key", "left")
    light = twice.where(F.col("copies") * HEAVY <= total).select("key", "kept")
    common = marked.where("hot").drop("hot")
    others = marked.where("hot IS NULL").drop("hot", "kept").join(light, "key", "left")
    back = F.when(F.col("kept").isNotNull() & ~F.col("id").eqNullSafe(F.col("kept")), F.col("kept"))
    return common.unionByName(others).select("id", "url", "payload", back.alias("refers_to"))


def record(date: str) -> Column:
    """The bytes of a WARC record, without the blank lines that end it, of (id, url, payload, refers_to)."""
    size = F.octet_length("payload").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(RECORD_END))
    back = F.col("refers_to").isNotNull()
    clean = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    block = F.when(back, head.cast("binary")).otherwise(F.concat(head.cast("binary"), F.col("payload")))
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(back, "revisit").otherwise("response"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <{ID}"),
        F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">\r\n"), F.coalesce(F.concat(F.lit("WARC-Target-URI: "), clean, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload")),
        F.when(back, F.concat(F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{ID}"),
                              F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(RECORD_END),
    ]
    return F.concat(F.concat(*lines).cast("binary"), block)


def write_archives(rows: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """The rows as WARC files under ``path``, each one gzip stream of at most FILE_ROWS records."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    plain = rows.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    said = with_responses(plain, least).select(record(date).cast("string").alias("value"))
    said.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).text(path)


class _Broken(Exception):
    pass


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of all gzip members in turn, a bounded piece at a time."""
    engine, at = zlib.decompressobj(31), 0
    pending = b""
    while True:
        try:
            out = engine.decompress(pending or data[at : at + PIECE], 8 * PIECE)
        except zlib.error as e:
            raise _Broken(str(e)) from None
        if not pending:
            at += PIECE
        if out:
            yield out
        if engine.eof:
            rest = engine.unused_data
            if not rest and at >= len(data):
                return
            engine, pending = zlib.decompressobj(31), rest
        else:
            pending = engine.unconsumed_tail
            if not pending and at >= len(data):
                raise _Broken("the stream ends early")


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _records(data: bytes) -> Iterator[tuple[bytes, dict[str, str]]]:
    """The whole records of an archive with their fields; only one record is held at a time."""
    buffer, pieces, done = bytearray(), _inflated(data), False

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while not done:
        seen = 0
        while (cut := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(buffer)
            if not more():
                if buffer.strip(b"\r\n"):
                    raise _Broken("a record's head ends early")
                return
        head = bytes(buffer[:cut])
        fields = _fields(head.lstrip(b"\r\n"))
        if not head.lstrip(b"\r\n").startswith(b"WARC/") or not fields.get("content-length", "").isdigit():
            raise _Broken("not a record's head")
        end = cut + 4 + int(fields["content-length"])
        while len(buffer) < end + 4:
            if not more():
                break
        if len(buffer) < end:
            raise _Broken("a record's block ends early")
        whole = bytes(buffer[:end]).lstrip(b"\r\n") + b"\r\n\r\n"
        del buffer[: end + 4 if buffer[end : end + 4] == b"\r\n\r\n" else end]
        yield whole, fields


def _bare(uri: str | None) -> str | None:
    return None if uri is None else uri.strip("<>")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of all records of the task's archives, then one row with the lines of their index."""
    index, offset, nth = [], 0, 0

    def row(kind: str, nth: int, value: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([nth], pa.int64()), pa.array([value], pa.binary())], ["kind", "nth", "value"])

    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            try:
                for whole, fields in _records(content.as_py()):
                    member = gzip.compress(whole, 6, mtime=0)
                    index.append({"offset": offset, "length": len(member), "type": fields.get("warc-type"), "id": _bare(fields.get("warc-record-id")),
                                  "uri": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest"), "from": path})
                    yield row("data", nth, member)
                    offset, nth = offset + len(member) + len(EMPTY_MEMBER), nth + 1
            except _Broken as e:
                index.append({"from": path, "broken": str(e), "after": nth})
    if index:
        yield row("index", nth, gzip.compress("".join(json.dumps(x) + "\n" for x in index).encode(), mtime=0))


def normalise(spark: SparkSession, source: str, target: str) -> None:
    """Members of all records under ``target/kind=data`` and their sidecars, by the same file names, under ``target/kind=index``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "content")
    rows = files.mapInArrow(_rewrite, _WRITTEN).sortWithinPartitions("kind", "nth")
    sink = rows.select("kind", F.col("value").cast("string").alias("value")).write.partitionBy("kind")
    sink.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(target)


def _folder(spark: SparkSession, target: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{target}/kind={kind}")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """(file, offset, length, type, id, uri, digest, from, broken, after): the lines of all sidecars."""
    fields = "offset bigint, length bigint, type string, id string, uri string, digest string, `from` string, broken string, after bigint"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["file"].to_pylist(), batch["content"]):
                said = gzip.decompress(content.as_py()).decode().splitlines()
                for lo in range(0, len(said), 10_000):
                    part = said[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part)], ["file", "line"])

    read = _folder(spark, target, "index").mapInArrow(lines, "file string, line string")
    return read.select("file", F.from_json("line", fields).alias("x")).select("file", "x.*")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every member of the files, inflated by itself: its place, and the fields and payload of its record."""
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for name, content in zip(batch["file"].to_pylist(), batch["content"]):
            data = content.as_py()
            at, rows, held = 0, [], 0
            while at < len(data):
                if data.startswith(EMPTY_MEMBER, at):
                    at += len(EMPTY_MEMBER)
                    continue
                whole, used = _member(data, at)
                rows.append((name, at, used, *_told(whole)))
                at, held = at + used, held + len(whole)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at an offset and its length in the file."""
    engine, out, pos = zlib.decompressobj(31), [], at
    view = memoryview(data)
    while not engine.eof:
        if pos >= len(data):
            raise ValueError("a member ends early")
        out.append(engine.decompress(view[pos : pos + PIECE]))
        pos += PIECE
    return b"".join(out), min(pos, len(data)) - at - len(engine.unused_data)


def _told(whole: bytes) -> tuple:
    """(type, id, uri, refers_to, payload_bytes, payload_digest, payload) of a record."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    if fields.get("warc-type") == "revisit":
        size, digest, payload = int(_fields(http).get("content-length", 0)), fields.get("warc-payload-digest", "").removeprefix("sha1:"), None
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return fields.get("warc-type"), _bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), _bare(fields.get("warc-refers-to")), size, digest, payload


def read_records(spark: SparkSession, target: str, payloads: bool = True) -> DataFrame:
    """The records that the sidecars under ``target`` list, read from their members; a listed record whose member is not there has nulls."""
    listed = read_index(spark, target).where("offset IS NOT NULL").select("file", "offset", "length")
    read = _folder(spark, target, "data").mapInArrow(_members, _RECORDS)
    if not payloads:
        read = read.drop("payload")
    return listed.join(read, ["file", "offset", "length"], "left")


def archive_round_trip(rows: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of every row, read back from its normalised archive."""
    spark = rows.sparkSession
    raw, target = scratch_path(spark, "warc-streams"), scratch_path(spark, "warc-members")
    kind = rows.schema[id_col].dataType
    write_archives(rows, raw, id_col, url, payload, least)
    normalise(spark, raw, target)
    drop_path(spark, raw)
    if not read_any(spark, target):
        return spark.createDataFrame([], f"{id_col} {kind.simpleString()}, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind.simpleString()}")

    def named(c: str) -> Column:
        bare = F.substring(c, len(ID) + 1, 1 << 30)
        return F.when(bare != "", bare).cast(kind)

    got = read_records(spark, target, payloads=False)
    return got.select(named("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))


def read_any(spark: SparkSession, target: str) -> bool:
    """Whether a normalised folder holds any records."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{target}/kind=index")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
