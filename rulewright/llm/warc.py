"""WARC in ZIP packages: a writer, and a reader that takes records out by ranges.

A package is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdx`` (one line per record: offset and length in that member). The reader parses the end-of-directory
records (ZIP64 too) and the central directory, finds the stored members, reads the index and then single records
by their byte ranges; nothing is unpacked to disk.

Paths are URIs for ``pyarrow.fs``: the shared folder of a cluster may be a local mount, HDFS or an object store.
Every attempt of a writing task writes a file of its own name, and only those listed by tasks that ended well are in
the manifest, so lost executors leave no half packages in a result.

Defined cases: a null payload is empty; a null id is written as ``none`` and read back as null; of equal payloads the
rows with the largest id are responses (repeated rows all are), the rest revisit it, and a null id revisits unless all
are null; an empty table gives no package; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import scratch, settled

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGE_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = DATE) -> bytes:
    """One WARC/1.1 record, uncompressed. With ``refers_to`` it is a revisit without payload, which still states the
    payload's digest and length."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
            f"WARC-Date: {date}", "WARC-Target-URI: " + " ".join((url or "about:blank").split()), f"WARC-Payload-Digest: sha1:{digest32(payload)}",
            "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; payload digest and length are counted from the payload where there is one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    urn = lambda k: None if (v := fields.get(k, "").removeprefix("<urn:page:").removesuffix(">")) in ("", "none") else v
    out = {"record_type": fields["warc-type"], "page_id": urn("warc-record-id"), "refers_to": urn("warc-refers-to"), "uri": fields.get("warc-target-uri")}
    if out["record_type"] == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return out | {"payload": None, "payload_bytes": size, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:")}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest32(payload)}


# Writing ------------------------------------------------------------------------------------------------------

class Package:
    """One ZIP package being written; records go out as they come, only index lines are held."""

    def __init__(self, folder: str, force_zip64: bool = True):
        self.uri = f"{folder}/{uuid.uuid4().hex}.wacz"
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=force_zip64)
        self.offset, self.index = 0, []

    def add(self, page_id, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.member.write(packed)
        self.index.append(f"{'none' if page_id is None else page_id} {self.offset} {len(packed)}")
        self.offset += len(packed)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.out.close()


def plan_records(pages: DataFrame, min_bytes: int = 0, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``(page_id, url, payload, refers_to)``: groups of equal payloads are counted before the shuffle, and only
    payloads that occur twice take part in the join, where AQE splits hot ones."""
    payload = F.coalesce(F.col(body), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    same = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    many = settled(same.where("n > 1 AND first IS NOT NULL").select("sha", "first"))
    later = F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))
    return rows.join(many, "sha", "left").select("page_id", "url", "payload", F.when(later & F.col("first").isNotNull(), F.col("first")).alias("refers_to"))


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write the planned records, one or more packages per task; returns the manifest ``(package, records)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None
        done = lambda p: (p.close(), pa.RecordBatch.from_pydict({"package": [p.uri], "records": [len(p.index)]}))[1]
        for batch in batches:
            for r in range(batch.num_rows):
                page_id, url, payload, refers_to = (batch.column(c)[r].as_py() for c in range(4))
                package = package or Package(folder)
                package.add(page_id, record(page_id, url, payload, refers_to))
                if package.offset >= package_bytes:
                    yield done(package)
                    package = None
        if package:
            yield done(package)

    return settled(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "package string, records long"))


# Reading ------------------------------------------------------------------------------------------------------

def _tail(f, size: int) -> tuple[int, int]:
    """Offset and size of the central directory, from the end records."""
    tail = min(size, 65557)
    f.seek(size - tail)
    data = f.read(tail)
    at = data.rfind(b"PK\x05\x06", 0, max(0, tail - 18))
    while at >= 0 and at + 22 + struct.unpack_from("<H", data, at + 20)[0] != tail:
        at = data.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    cd_size, cd_offset = struct.unpack_from("<II", data, at + 12)
    entries = struct.unpack_from("<H", data, at + 10)[0]
    if 0xFFFFFFFF in (cd_size, cd_offset) or entries == 0xFFFF:
        f.seek(size - tail + at - 20)
        locator = f.read(20)
        if locator[:4] == b"PK\x06\x07":
            f.seek(struct.unpack_from("<Q", locator, 8)[0])
            end64 = f.read(56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("bad ZIP64 end of central directory")
            cd_size, cd_offset = struct.unpack_from("<QQ", end64, 40)
    return cd_offset, cd_size


def members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (offset of the data, length, compression method) of every member, from the central directory."""
    offset, length = _tail(f, size)
    f.seek(offset)
    cd, at, out = f.read(length), 0, {}
    while at + 46 <= len(cd) and cd[at:at + 4] == b"PK\x01\x02":
        method, = struct.unpack_from("<H", cd, at + 10)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", cd, at + 20)
        local, = struct.unpack_from("<I", cd, at + 42)
        name = cd[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra, e = cd[at + 46 + n_name:at + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: only the fields that didn't fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            e += 4 + n
        out[name] = (local, packed, method)
        at += 46 + n_name + n_extra + n_comment
    for name, (local, packed, method) in out.items():
        f.seek(local + 26)
        n_name, n_extra = struct.unpack("<HH", f.read(4))
        out[name] = (local + 30 + n_name + n_extra, packed, method)
    return out


def locate(packages: DataFrame) -> DataFrame:
    """``(package, offset, length)`` of every record, absolute in the package file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                size = fs.get_file_info(path).size
                with fs.open_input_file(path) as f:
                    found = members(f, size)
                    start, _, method = found[DATA]
                    if method or found[INDEX][2]:
                        raise ValueError(f"{uri}: members must be stored")
                    f.seek(found[INDEX][0])
                    lines = io.BytesIO(f.read(found[INDEX][1]))
                    rows = [x.split() for x in lines if x.strip()]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(rows), pa.string()), pa.array([start + int(x[-2]) for x in rows], pa.int64()),
                                                  pa.array([int(x[-1]) for x in rows], pa.int64())], ["package", "offset", "length"])

    return packages.select("package").mapInArrow(run, "package string, offset long, length long")


def read_ranges(index: DataFrame, payload: bool = False) -> DataFrame:
    """Read the records at the given ranges."""
    schema = pa.schema([("page_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, f = None, None
        for batch in batches:
            rows, held = [], 0
            for u, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if u != uri:
                    fs, path = pafs.FileSystem.from_uri(u)
                    uri, f = u, fs.open_input_file(path)
                f.seek(offset)
                rows.append(parse(gzip.decompress(f.read(length))))
                held += rows[-1]["payload_bytes"] * payload
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    ddl = "page_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payload
    return index.select("package", "offset", "length").mapInArrow(run, ddl)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as packages in the shared folder and read every record back."""
    manifest = write_packages(plan_records(pages, min_bytes), scratch(pages.sparkSession))
    spread = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return read_ranges(locate(manifest.repartition(int(spread), "package")))
