"""WARC files: what is written is read back, member by member, at the offsets that the sidecars name."""

import base64
import gzip
import hashlib
import zlib

from tidegauge.llm import warc


def b32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, payload string, kept int")


ROWS = [
    (1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (4, "http://a/ b\r\nX: y", "own\r\n\r\nWARC/1.1\r\n"), (5, "u", None), (6, "u", ""),
    (7, "u", "é" * 70_000), (None, "u", "same"), (None, "u", "alone"), (12, "u", "twice"), (12, "u", "twice"), (3, "u", "twice"),
]


def test_round_trip(spark):
    got = sorted((tuple(r) for r in warc.archive_round_trip(frame(spark, ROWS)).collect()), key=str)
    kept = {"same": 9, "": 6, "twice": 12}
    want = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        back = kept.get(h or "")
        back = None if back == i else back
        want.append((i, len(p), b32(p), "response" if back is None else "revisit", back))
    assert got == sorted(want, key=str)


def test_only_payloads_of_some_length_are_revisited(spark):
    got = {r["page_id"]: r["record_type"] for r in warc.archive_round_trip(frame(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_table(spark):
    out = warc.archive_round_trip(frame(spark, []))
    assert out.collect() == [] and out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_hot_payload_by_broadcast_and_join(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"pair {i // 4}") for i in range(400)]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(frame(spark, rows)).collect()}
    last = {}
    for i, _, h in rows:
        last[h] = i
    assert got == {i: ("response", None) if last[h] == i else ("revisit", last[h]) for i, _, h in rows}


def test_streams_become_members_with_an_index(spark, tmp_path):
    raw, target = str(tmp_path / "raw"), str(tmp_path / "members")
    warc.write_archives(frame(spark, ROWS).repartition(3), raw)
    streams = list((tmp_path / "raw").glob("part-*.gz"))
    for f in streams:  # one gzip member over all records
        engine = zlib.decompressobj(31)
        engine.decompress(f.read_bytes())
        assert engine.eof and not engine.unused_data
    warc.normalise(spark, raw, target)
    data = {f.name: f.read_bytes() for f in (tmp_path / "members" / "kind=data").glob("part-*")}
    assert sorted(x for b in data.values() for x in gzip.decompress(b).split(b"WARC/1.1\r\nWARC-Type") if x) == sorted(
        x for f in streams for x in gzip.decompress(f.read_bytes()).split(b"WARC/1.1\r\nWARC-Type") if x)
    listed = warc.read_index(spark, target).collect()
    assert len(listed) == len(ROWS) and {r["file"] for r in listed} == set(data)
    for r in listed:
        member = data[r["file"]][r["offset"] : r["offset"] + r["length"]]
        engine = zlib.decompressobj(31)
        whole = engine.decompress(member)
        assert engine.eof and not engine.unused_data and whole.startswith(b"WARC/1.1\r\n") and whole.endswith(b"\r\n\r\n") and f"<{r['id']}>".encode() in whole
    read = {r["id"]: r for r in warc.read_records(spark, target).collect()}
    assert bytes(read[f"{warc.ID}4"]["payload"]) == b"own\r\n\r\nWARC/1.1\r\n" and read[f"{warc.ID}4"]["uri"] == "http://a/%20b%20%20X:%20y"
    assert read[f"{warc.ID}9"]["uri"] is None and read[f"{warc.ID}1"]["refers_to"] == f"{warc.ID}9" and read[f"{warc.ID}1"]["payload_bytes"] == 4


def record(body: bytes, n: int) -> bytes:
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, len(body), body)


def test_foreign_and_damaged_streams(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    body = bytes(range(256)) * 5000
    several = b"".join(gzip.compress(record(body, n)) for n in range(3))
    (tmp_path / "raw" / "members.warc.gz").write_bytes(several)
    stream = gzip.compress(record(b"first", 10) + record(body, 11))
    (tmp_path / "raw" / "short.warc.gz").write_bytes(stream[: len(stream) - 40])
    (tmp_path / "raw" / "junk.warc.gz").write_bytes(b"not gzip")
    warc.normalise(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    lines = warc.read_index(spark, str(tmp_path / "out")).collect()
    assert sorted(r["id"] for r in lines if r["id"]) == ["r0", "r1", "r10", "r2"]
    assert {r["from"].rsplit("/", 1)[1] for r in lines if r["broken"]} == {"short.warc.gz", "junk.warc.gz"}
    read = {r["id"]: r for r in warc.read_records(spark, str(tmp_path / "out")).collect()}
    assert len(read) == 4 and read["r0"]["record_type"] == "resource"
