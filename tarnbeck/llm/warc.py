"""Operator 4, dictionary-compressed WARC archives.

Each archive is a .warc.zst file: a skippable frame (0x184D2A5D) with a Zstandard dictionary built from the first records of
its partition, then one Zstandard frame per record, so that any record can be read alone with the dictionary. A partition of
fewer than SAMPLES records, or with too little text to train on, has archives without a dictionary. Of records with
equal payloads the one with the largest page_id is a response, the others are revisits that refer to it and carry no
payload; payloads shorter than min_bytes are always responses.

The response of a payload is found by a partial maximum per digest. Digests that hold a thousandth of all rows or more, at
most a thousand by number, are joined by broadcast, so that a payload shared by a third of the pages loads no single task;
the rest is joined by a shuffle. Files get their name only when complete and hold the same records on a second attempt.

Nulls: a null payload is empty; a null page_id sorts below all others; a null url is written as an empty target. Rows that
repeat the largest page_id of a payload are all responses. An empty table gives archives without records or none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_file, open_file, shared_path, table, written

MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:tarnbeck:page:"
#: Bytes of records that a dictionary is built from (of each its first RECORD_BYTES, of SAMPLES records at least), its size,
#: and the bytes after which an archive is closed.
SAMPLE_BYTES, RECORD_BYTES, SAMPLES, DICTIONARY_BYTES, ARCHIVE_BYTES = 4 << 20, 64 << 10, 8, 64 << 10, 256 << 20
#: Digests with this share of the rows or more go by broadcast; there are at most 1 / HOT of them.
HOT = 1 / 1000


def record_id(page_id: int | None) -> str:
    return f"<{NAME}{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    x = name.strip("<>")[len(NAME) :]
    return int(x) if x else None


def render(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c for c in url if c not in "\r\n")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int):
    """A trained dictionary, or None where there is too little to train on."""
    import zstandard

    if len(samples) < SAMPLES or sum(map(len, samples)) < 8 * 1024:
        return None
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 8), samples, k=512, d=8)
    except zstandard.ZstdError:
        return None


def deduplicated(pages: DataFrame, key: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, digest hex, response long or null): response is the largest page_id with that payload."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    src = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = written(src.where(F.length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1"), "payloads")
    least = max(2, int(HOT * pages.count()))
    hot = groups.where(F.col("n") >= least).select("digest", "response")
    cold = groups.where(F.col("n") < least).select("digest", "response")
    return src.join(F.broadcast(hot), "digest").unionByName(src.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(cold, "digest", "left"))


def write_archives(pages: DataFrame, to: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> DataFrame:
    """Writes archives below `to`; returns their list (path, n_records, n_bytes, dictionary_bytes), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, made = TaskContext.get().partitionId(), []

        def records() -> Iterator[bytes]:
            for b in batches:
                for digest, page, uri, body, response in zip(*(b.column(c).to_pylist() for c in ("digest", "page_id", "url", "payload", "response")), strict=True):
                    yield render(page, uri, body, base64.b32encode(bytes.fromhex(digest)).decode(), response, response is not None and response != page, date)

        rest, head, size = records(), [], 0
        for r in rest:
            head.append(r)
            size += min(len(r), RECORD_BYTES)
            if size >= SAMPLE_BYTES:
                break
        known = dictionary([r[:RECORD_BYTES] for r in head], DICTIONARY_BYTES)
        todo = iter(head)
        while head:
            name, n, size = f"{to}/part-{part:06d}-{len(made):04d}.warc.zst", 0, 0
            comp = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True)
            with new_file(name) as f:
                raw = known.as_bytes() if known else b""
                if raw:
                    size += f.write(struct.pack("<II", MAGIC, len(raw)) + raw) or 8 + len(raw)
                more = False
                for source in (todo, rest):
                    for r in source:
                        x = comp.compress(r)
                        f.write(x)
                        n, size = n + 1, size + len(x)
                        if size >= ARCHIVE_BYTES:
                            more = True
                            break
                    if more:
                        break
            made.append((name, n, size, len(raw)))
            if not more:
                break
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), *(pa.array([m[i] for m in made], pa.int64()) for i in (1, 2, 3))], names=["path", "n_records", "n_bytes", "dictionary_bytes"])

    return written(deduplicated(pages, key, url, payload, min_bytes).mapInArrow(run, "path string, n_records long, n_bytes long, dictionary_bytes long"), "archives")


def parse(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC fields, HTTP fields, payload) of each record, names in lower case; a response's digest is checked."""
    import zstandard

    with open_file(path) as f:
        start, known = f.read(8), None
        if len(start) == 8 and struct.unpack("<II", start)[0] == MAGIC:
            known, start = zstandard.ZstdCompressionDict(f.read(struct.unpack("<II", start)[1])), b""

        class Joined:
            def read(self, n: int = -1) -> bytes:
                nonlocal start
                if start:
                    x, start = start, b""
                    return x
                return f.read(n)

        stream = zstandard.ZstdDecompressor(dict_data=known).stream_reader(Joined(), read_across_frames=True)
        buffer = b""

        def until(n: int) -> None:
            nonlocal buffer
            parts, have = [buffer], len(buffer)
            while have < n:
                x = stream.read(1 << 18)
                if not x:
                    break
                parts.append(x)
                have += len(x)
            buffer = b"".join(parts)

        fields = lambda head: {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
        while True:
            while (at := buffer.find(b"\r\n\r\n")) < 0:
                had = len(buffer)
                until(had + 1)
                if len(buffer) == had:
                    if had:
                        raise ValueError(f"{path}: cut off")
                    return
            warc = fields(buffer[:at])
            n = int(warc["content-length"])
            until(at + 8 + n)
            block = buffer[at + 4 : at + 4 + n]
            if buffer[at + 4 + n : at + 8 + n] != b"\r\n\r\n":
                raise ValueError(f"{path}: a record has the wrong length")
            buffer = buffer[at + 8 + n :]
            http, _, payload = block.partition(b"\r\n\r\n")
            if warc["warc-type"] == "response" and "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() != warc["warc-payload-digest"]:
                raise ValueError(f"{path}: {warc['warc-record-id']} has another digest")
            yield warc, fields(http), payload


def read_archives(files: DataFrame, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_digest, payload_bytes, refers_to[, payload]) of every record in the listed archives."""
    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long" + ", payload binary" * payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * payload]
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * payload]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for warc, http, body in parse(path):
                    kind = warc["warc-type"]
                    rows.append((page_of(warc["warc-record-id"]), warc["warc-target-uri"], kind, warc["warc-payload-digest"].removeprefix("sha1:"), len(body) if kind == "response" else int(http["content-length"]), page_of(warc["warc-refers-to"]) if kind == "revisit" else None, *[body if kind == "response" else None] * payload))
                    if len(rows) == 256:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return files.select("path").repartition(max(1, min(10_000, files.count())), "path").mapInArrow(run, schema)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_archives(table(spark, sf_dir, "pages"), shared_path(spark, "op4"))
    return read_archives(files, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "CAST('0x' || substr(h, 1 + 5 * {i}, 5) AS BIGINT)"
_QUAD = " || ".join(f"substr('{_ALPHABET}', 1 + CAST(({_FIVE} >> {s}) & 31 AS BIGINT), 1)" for s in (15, 10, 5, 0))
OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h FROM p),
m AS (SELECT h, max(page_id) AS response FROM d GROUP BY h)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes,
       {' || '.join(_QUAD.format(i=i).replace('substr(h,', 'substr(d.h,') for i in range(8))} AS payload_digest,
       CASE WHEN d.page_id = m.response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> m.response THEN m.response END AS refers_to
FROM d JOIN m ON d.h = m.h
"""
