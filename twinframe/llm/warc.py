"""WARC archives packed in ZIP files.

An archive is a ZIP of stored (uncompressed) members: archive/data.warc.gz, in which each record is a gzip member of
its own, indexes/index.jsonl with a line for each record (its offset and length inside that member), and
datapackage.json. A reader never extracts anything: it reads the end of the file, finds the central directory (or,
past the 32-bit limits, the ZIP64 one), from there the index member, and then just the byte ranges of the records.
Files are opened through pyarrow's file systems, so local, HDFS, S3 and GCS paths are read alike.

Archives made elsewhere are read too: any stored members named *.warc.gz, found through indexes of JSON lines or CDXJ lines
(a key, a time stamp, JSON with offset, length and filename), or, without an index, by walking the gzip members; records
of any type, with identifiers of any form, with or without a digest.

Records with equal payloads are written once, as response; the others become revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import new_path, written

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.jsonl", "datapackage.json"
DATE = "2020-01-01T00:00:00Z"  # capture times are not known; the field is mandatory
URN = "urn:x-record:"
TASK = 16 << 20  # packed bytes that a task reads


# ---- files ----


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class RangeFile:
    """Byte ranges of a file in any store."""

    def __init__(self, path: str):
        system, inner = _fs(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or offset + length > self.size:
            raise ValueError("range beyond the end of the archive")
        return self.file.read_at(length, offset)

    def close(self) -> None:
        self.file.close()


# ---- ZIP directories ----


def directory(f: RangeFile) -> dict[str, tuple[int, int, int, int]]:
    """Name -> (method, compressed size, size, offset of the local header), from the central directory."""
    tail = f.read(f.size - min(f.size, 22 + 65535), min(f.size, 22 + 65535))
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
        at -= 1
    if at < 0:
        raise ValueError("no ZIP directory at the end of the file")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end = f.size - len(tail) + at
    if end >= 20 and (entries == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF):
        locator = f.read(end - 20, 20)
        if locator[:4] == b"PK\6\7":
            record = f.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("the ZIP64 locator does not lead to a ZIP64 directory record")
            entries, size, offset = struct.unpack_from("<QQQ", record, 32)
    raw, at, found = f.read(offset, size), 0, {}
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\1\2":
            raise ValueError("damaged ZIP directory")
        method, packed, plain = struct.unpack_from("<H8xII", raw, at + 10)
        n, extra, comment = struct.unpack_from("<HHH", raw, at + 28)
        local = struct.unpack_from("<I", raw, at + 42)[0]
        name = raw[at + 46 : at + 46 + n].decode("utf-8", "replace")
        values = [plain, packed, local]
        wide = [k for k in range(3) if values[k] == 0xFFFFFFFF]
        x, last = at + 46 + n, at + 46 + n + extra
        while wide and x + 4 <= last:
            tag, length = struct.unpack_from("<HH", raw, x)
            if tag == 1:
                for k, v in zip(wide, struct.unpack_from(f"<{len(wide)}Q", raw, x + 4)):
                    values[k] = v
                break
            x += 4 + length
        found[name] = (method, values[1], values[0], values[2])
        at += 46 + n + extra + comment
    return found


def stored_range(f: RangeFile, entry: tuple[int, int, int, int]) -> tuple[int, int]:
    """Offset and length of a stored member's bytes."""
    method, packed, plain, local = entry
    if method or packed != plain:
        raise ValueError("the member is compressed: its records can't be read by range")
    head = f.read(local, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("damaged local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    return local + 30 + name + extra, plain


# ---- records ----


def digest_text(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


def record_bytes(record: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record, packed as a gzip member. A revisit has the HTTP header, with the full payload's length, and
    no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{record}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{URN}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(packed: bytes) -> dict:
    """Fields and payload of one packed record. Checks lengths, and the digest of a response."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :].strip(b"\r\n"):
        raise ValueError("a record's length is wrong")
    kind, digest, payload, length = fields["warc-type"], fields.get("warc-payload-digest"), block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        stated = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        length = stated[0] if kind == "revisit" and stated else len(payload)
    is_own = fields.get("warc-record-id", "").startswith(f"<{URN}")
    found = digest_text(hashlib.sha1(payload).digest())
    if kind == "response" and is_own and digest != f"sha1:{found}":
        raise ValueError("a payload does not match its digest")
    digest = digest.removeprefix("sha1:") if digest else None if kind == "revisit" else found
    name = lambda k: fields[k].strip("<>") if k in fields else None
    number = lambda x: int(x[len(URN) :]) if x and re.fullmatch(rf"{re.escape(URN)}-?[0-9]+", x) else None
    own, other = name("warc-record-id"), name("warc-refers-to")
    return {"record": number(own), "record_id": own, "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_bytes": length, "payload_digest": digest, "refers_to": number(other), "refers_to_id": other, "payload": None if kind == "revisit" else payload}


# ---- writing ----


class ArchiveWriter:
    """Streams records into one archive; the file gets its name when it is whole."""

    def __init__(self, folder: str):
        self.name = f"{folder}/part-{uuid.uuid4().hex}.zip"
        self.system, inner = _fs(self.name)
        self.final, self.draft = inner, f"{inner}.draft"
        self.system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.offset, self.records, self.index = 0, 0, []

    def add(self, record: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> None:
        packed = record_bytes(record, url, payload, digest, refers_to)
        self.member.write(packed)
        self.index.append(json.dumps({"record": record, "offset": self.offset, "length": len(packed)}))
        self.offset += len(packed)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        index = zipfile.ZipInfo(INDEX)
        self.zip.writestr(index, "".join(f"{x}\n" for x in self.index))
        self.zip.writestr(zipfile.ZipInfo(PACKAGE), json.dumps({"profile": "data-package", "resources": [{"name": "data", "path": DATA}, {"name": "index", "path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        self.system.move(self.draft, self.final)
        return self.name, self.records, self.offset


def write_archives(df: DataFrame, record: str, url: str, payload: str, folder: str | None = None, min_bytes: int = 0, max_archive_bytes: int = 1 << 30) -> DataFrame:
    """Writes one record for each row of `df` and returns a table of archives (path, records, data_bytes).

    `record` is an integer column, `payload` text (written as UTF-8) or binary; null payloads are empty. Of the rows
    with equal payloads of at least `min_bytes` bytes, those with the largest record number are responses (rows that
    repeat that number too), the rest revisit it; a null number is never the largest. Equality is of SHA-1 digests.
    A null url leaves the target URI out; control characters in it are percent-encoded. Other columns are ignored.
    The rows, with payloads, are shuffled once, by digest; a digest that many rows share is met with AQE's split of
    skewed joins, the other side having one row for each digest. An empty table gives no archive.
    A task that is run again writes a file of another name; only the names in the returned table count.
    """
    spark = df.sparkSession
    folder = folder or new_path(spark, "warc")
    body = F.coalesce(df[payload].cast("binary"), F.lit(b""))
    rows = df.select(df[record].cast("bigint").alias("record"), df[url].cast("string").alias("url"), body.alias("payload"), F.unhex(F.sha1(body)).alias("digest"))
    shared = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("record").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 and owner is not null").drop("n")
    joined = rows.join(shared, "digest", "left").withColumn("refers_to", F.when(~F.col("record").eqNullSafe(F.col("owner")), F.col("owner"))).drop("owner")

    def write(batches):
        out, writer = [], None
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                writer = writer or ArchiveWriter(folder)
                refers = c["refers_to"][i].as_py()
                writer.add(str(c["record"][i].as_py()), c["url"][i].as_py(), c["payload"][i].as_py(), digest_text(c["digest"][i].as_py()), None if refers is None else str(refers))
                if writer.offset >= max_archive_bytes:
                    out.append(writer.close())
                    writer = None
        if writer:
            out.append(writer.close())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "data_bytes"])

    manifest = new_path(spark, "warc-manifest")
    joined.mapInArrow(write, "path string, records bigint, data_bytes bigint").write.parquet(manifest)
    return spark.read.parquet(manifest)


# ---- reading ----


def locate(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """(path, offset, length) of every record in the archives of the `path` column, from the archives' indexes, or, where an
    archive has none, from a walk over its data."""

    def lines_of(f, at, length):
        left, done = b"", 0
        while done < length:
            piece = f.read(at + done, min(1 << 22, length - done))
            done += len(piece)
            lines = (left + piece).split(b"\n")
            left = lines.pop()
            yield [x for x in lines if x]
        yield [left] if left else []

    def indexed(f, members, entry):
        for lines in lines_of(f, *stored_range(f, entry)):
            out = []
            for x in (json.loads(line[line.index(b"{") :]) for line in lines if b"{" in line):
                own = x.get("filename")
                start, size = members[own] if own in members else next(iter(members.values()))
                offset, length = int(x["offset"]), int(x["length"])
                if offset + length > size:
                    raise ValueError("the index leads beyond the archive's data")
                out.append((start + offset, length))
            yield out

    def walked(f, members):
        for start, size in members.values():
            at = begin = 0
            unpack = zlib.decompressobj(31)
            while at < size:
                piece = f.read(start + at, min(1 << 22, size - at))
                at += len(piece)
                out = []
                while piece:
                    unpack.decompress(piece)
                    piece = unpack.unused_data
                    if unpack.eof:
                        end = at - len(piece)
                        out.append((start + begin, end - begin))
                        begin, unpack = end, zlib.decompressobj(31)
                yield out

    def each(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                f = RangeFile(path)
                names = directory(f)
                members = {n.rpartition("/")[2]: stored_range(f, e) for n, e in sorted(names.items()) if n.endswith(".warc.gz")}
                indexes = [e for n, e in sorted(names.items()) if n.startswith("indexes/") and n.endswith((".jsonl", ".cdxj", ".cdx"))]
                for found in chain.from_iterable(indexed(f, members, e) for e in indexes) if indexes else walked(f, members):
                    if found:
                        offset, length = zip(*found)
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["path", "offset", "length"])
                f.close()

    return paths.select("path").mapInArrow(each, "path string, offset bigint, length bigint")


def read_archives(spark: SparkSession, paths: DataFrame, payloads: bool = True, block: int = 1 << 22) -> DataFrame:
    """One row for each record: record bigint and record_id, target_uri, record_type, payload_bytes, payload_digest,
    refers_to bigint and refers_to_id and, if `payloads`, payload binary (null for revisits). The numbers are null unless
    the identifiers are this module's own. Records are read by range, neighbours in one read of about `block` bytes. The
    places of records, not the archives, are dealt to as many tasks as their bytes ask for, TASK bytes each, so one large
    archive is read by many."""
    names = ["record", "record_id", "target_uri", "record_type", "payload_bytes", "payload_digest", "refers_to", "refers_to_id"] + ["payload"] * payloads
    kinds = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())))

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    def each(batches):
        f, opened, rows, held = None, None, [], 0
        for batch in batches:
            places = sorted(zip(*(batch.column(n).to_pylist() for n in ("path", "offset", "length"))))
            k = 0
            while k < len(places):
                path, start, length = places[k]
                end, last = start + length, k + 1
                while last < len(places) and places[last][0] == path and places[last][1] - end < 65536 and places[last][1] + places[last][2] - start <= block:
                    end = places[last][1] + places[last][2]
                    last += 1
                if path != opened:
                    if f:
                        f.close()
                    f, opened = RangeFile(path), path
                raw = f.read(start, end - start)
                for _, at, n in places[k:last]:
                    r = parse_record(raw[at - start : at - start + n])
                    rows.append(r)
                    held += r["payload_bytes"]
                if len(rows) >= 5000 or held > 1 << 25:
                    yield flush(rows)
                    rows, held = [], 0
                k = last
        if f:
            f.close()
        if rows:
            yield flush(rows)

    places = written(locate(spark, paths), "warc-places")
    total = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK))
    placed = places.repartition(tasks, "path", F.floor(F.col("offset") / block))  # a stated number is not merged for the places' small size
    schema = "record bigint, record_id string, target_uri string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_id string" + ", payload binary" * payloads
    return placed.mapInArrow(each, schema)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, unhex(sha1(coalesce(html, ''))) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS owner FROM p),
bits AS (SELECT page_id, octet_length(b) AS n, owner, array_to_string(list_transform(range(1, 41), lambda i: to_base(('0x' || substr(hex(d), i, 1))::INT, 2, 4)), '') AS s FROM m)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda k: substr(s, 5 * i + k, 1)::INT * (1 << (5 - k))))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM bits"""
