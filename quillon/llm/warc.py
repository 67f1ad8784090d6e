"""WARC records in ZIP packages, and a reader that finds and range-reads them without extraction.

Each task writes one package: a ZIP archive with two stored members, the WARC file, whose records are compressed one by one,
and an index with the place of every record. The reader takes the end-of-central-directory record (or its ZIP64 form), the
central directory and a member's local header to find where the member's bytes begin, and reads records by offset.

Of records with equal payloads of at least LEAST bytes, that with the largest page_id is a response and the others revisit
it. Equality is of the SHA-1 digest and length.

Edge cases: null payloads are empty; null urls leave out the target; rows with the same page_id as the response are
responses too; null page_ids are kept and revisit a group's response; if all of a group are null, all are responses; an
empty table writes no package.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import files
from quillon.llm.common import shared_path, small, stage

LEAST = 1000
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
BROADCAST_GROUPS = 200_000
DATE = "2024-01-01T00:00:00Z"
# Record layouts of the ZIP format.
END, END64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def members(file) -> dict[str, Member]:
    """The central directory of a ZIP archive, by range reads; ZIP64 sizes, counts and offsets are followed."""
    size = file.size()
    tail = file.read_at(min(size, 22 + 65535), max(0, size - 22 - 65535))
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP archive")
    _, _, _, count, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        end_at = size - len(tail) + at
        sign, _, where, _ = struct.unpack("<4sIQI", file.read_at(20, end_at - 20))
        if sign != LOCATOR:
            raise ValueError("the ZIP64 locator is missing")
        sign, _, _, _, _, _, _, count, length, start = struct.unpack("<4sQHHIIQQQQ", file.read_at(56, where))
        if sign != END64:
            raise ValueError("the ZIP64 end record is missing")
    data, at, found = file.read_at(length, start), 0, {}
    for _ in range(count):
        sign, _, _, flags, method, _, _, _, packed, full, n_name, n_extra, n_note, _, _, _, header = struct.unpack_from("<4sHHHHHHIIIHHHHHII", data, at)
        if sign != ENTRY:
            raise ValueError("the central directory is damaged")
        name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # 8-byte values stand only for fields that are full
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                header = next(values) if header == 0xFFFFFFFF else header
            k += 4 + n
        found[name] = Member(name, method, full, packed, header)
        at += 46 + n_name + n_extra + n_note
    return found


def data_start(file, member: Member) -> int:
    """Where the bytes of a stored member begin: behind its local header, whose name and extra lengths may differ."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed, not stored")
    sign, n_name, n_extra = struct.unpack("<4s22xHH", file.read_at(30, member.header))
    if sign != LOCAL:
        raise ValueError(f"{member.name}: the local header is damaged")
    return member.header + 30 + n_name + n_extra


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """One uncompressed WARC record. A revisit has no payload; its HTTP header keeps the full length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if ord(c) > 32 and ord(c) != 127 else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes, level: int = 3) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of an uncompressed record; names in lower case."""
    fields = lambda x: {k.decode().strip().lower(): v.decode("utf-8", "surrogatepass").strip() for k, v in (line.split(b":", 1) for line in x.split(b"\r\n")[1:] if b":" in line)}
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def typed(pages: DataFrame, html: str = "html", least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, refers_to: refers_to is the response's page_id for revisits, else null."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    keyed = pages.select("page_id", "url", body.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    groups = keyed.where(F.col("size") >= least).groupBy(F.col("digest").alias("g_digest"), F.col("size").alias("g_size")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.where("n > 1").drop("n"), "groups")
    joined = keyed.join(small(groups, BROADCAST_GROUPS), (F.col("digest") == F.col("g_digest")) & (F.col("size") == F.col("g_size")), "left")
    other = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("keeper")).alias("refers_to"))


def write(pages: DataFrame, to: str, html: str = "html", least: int = LEAST) -> DataFrame:
    """Write packages below the URI `to`; the table of packages: uri, n_records."""
    files.make_dir(to)

    def save(batches):
        uri, lines, offset, manager, pack, member = f"{to}/pages-{TaskContext.get().partitionId():06d}.wacz", [], 0, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if pack is None:
                    manager = files.written(uri)
                    pack = zipfile.ZipFile(manager.__enter__(), "w", zipfile.ZIP_STORED)
                    member = pack.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)
                data = zipped(record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"], row["refers_to"] is not None))
                member.write(data)
                lines.append(json.dumps({"id": row["page_id"], "offset": offset, "length": len(data)}))
                offset += len(data)
        if pack is not None:
            member.close()
            with pack.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                index.write("\n".join(lines).encode())
            pack.close()
            manager.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [len(lines)]})

    return stage(typed(pages, html, least).mapInArrow(save, "uri string, n_records long"), "packages")


def records(file):
    """(WARC headers, HTTP headers, payload) of each record of a package, by its index."""
    found = members(file)
    index, start = found[INDEX], data_start(file, found[WARC])
    for line in file.read_at(index.size, data_start(file, index)).splitlines():
        entry = json.loads(line)
        yield parsed(zlib.decompress(file.read_at(entry["length"], start + entry["offset"]), 31))


def read(packages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from the packages."""
    number = lambda urn: None if urn is None or urn.endswith(":None>") else int(urn.rpartition(":")[2].rstrip(">"))

    def load(batches):
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows = []
                with files.opened(uri) as file:
                    for warc, http, payload in records(file):
                        digest, size, kind = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"]), warc["warc-type"]
                        if kind == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{uri}: a payload does not match its digest")
                        rows.append((number(warc["warc-record-id"]), size, digest, kind, number(warc.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, min(4096, packages.count()))
    return packages.select("uri").repartition(n).mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_table(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write pages to packages and read them back."""
    return read(write(pages, shared_path(spark, "warc")))
