"""Web archives inside ZIP files: a writer, and a reader that fetches single records by range.

A ZIP file holds one stored member of WARC records (each a gzip member of its own) and one stored
member of index lines that give every record's place. The reader finds the directories from the
end of the file (also the ZIP64 ones), locates the stored members, reads the index and then only
the byte ranges of records; nothing is unpacked to disk.

Files lie in the shared folder of the cluster and are reached by its URI from the executors.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import slices
from duskwatch.session import materialize, scratch

ARCHIVE_BYTES = 64 << 20  # of records, in one archive; they are held while it is written
RANGE_BYTES = 4 << 20  # neighbouring records are fetched together up to that size
LEAST_REVISIT_BYTES = 0
RECORDS, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"  # pages carry no time; a fixed one keeps archives reproducible
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LOCAL, _CENTRAL, _END, _END64, _FIND64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_FULL = 0xFFFFFFFF


# --- ZIP -------------------------------------------------------------------------------------------

def zip_stored(members: list[tuple[str, bytes]], zip64: bool = True) -> Iterator[bytes]:
    """The pieces of a ZIP file with stored members; with ``zip64``, sizes stand in its fields."""
    at, directory = 0, []
    for name, data in members:
        encoded, crc, size = name.encode(), zlib.crc32(data), len(data)
        extra = struct.pack("<HHQQ", 1, 16, size, size) if zip64 else b""
        short = _FULL if zip64 else size
        head = _LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, short, short, len(encoded),
                                    len(extra)) + encoded + extra
        yield head
        yield data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if zip64 else b""
        directory.append(_CENTRAL + struct.pack(
            "<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, short, short, len(encoded), len(extra), 0,
            0, 0, 0, _FULL if zip64 else at) + encoded + extra)
        at += len(head) + size
    whole = b"".join(directory)
    yield whole
    n = len(members)
    if zip64:
        yield _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(whole), at)
        yield _FIND64 + struct.pack("<IQI", 0, at + len(whole), 1)
        yield _END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, _FULL, _FULL, 0)
    else:
        yield _END + struct.pack("<HHHHIIH", 0, 0, n, n, len(whole), at, 0)


def _read(file, at: int, n: int) -> bytes:
    file.seek(at)
    data = file.read(n)
    if len(data) != n:
        raise ValueError(f"the archive ends within {n} bytes at {at}")
    return data


def stored_members(file) -> dict[str, tuple[int, int]]:
    """Name to (offset of the data, size) of the stored members of an open ZIP file."""
    size = file.size()
    tail_at = max(0, size - 22 - 0xFFFF)
    tail = _read(file, tail_at, size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of a central directory")
    n, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
    place = tail_at + end - 20
    if place >= 0 and (n == 0xFFFF or length == _FULL or at == _FULL):
        found = _read(file, place, 20)
        if found[:4] == _FIND64:
            end64 = _read(file, struct.unpack("<Q", found[8:16])[0], 56)
            if end64[:4] != _END64:
                raise ValueError("no ZIP64 end of a central directory where it is said to be")
            n, length, at = struct.unpack("<QQQ", end64[32:56])
    directory, p, out = _read(file, at, length), 0, {}
    for _ in range(n):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("a broken entry in the central directory")
        method = struct.unpack("<H", directory[p + 10 : p + 12])[0]
        packed, full, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[p + 20 : p + 34])
        local = struct.unpack("<I", directory[p + 42 : p + 46])[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            kind, m = struct.unpack("<HH", extra[q : q + 4])
            if kind == 1:
                # Only the fields that do not fit above are there, in this order.
                wide = list(struct.unpack(f"<{m // 8}Q", extra[q + 4 : q + 4 + m // 8 * 8]))
                full = wide.pop(0) if full == _FULL else full
                packed = wide.pop(0) if packed == _FULL else packed
                local = wide.pop(0) if local == _FULL else local
            q += 4 + m
        if method == 0:
            head = _read(file, local, 30)
            if head[:4] != _LOCAL:
                raise ValueError(f"no local header of {name}")
            skip = sum(struct.unpack("<HH", head[26:30]))
            out[name] = (local + 30 + skip, full)
        p += 46 + n_name + n_extra + n_note
    return out


# --- WARC ------------------------------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """Control characters cannot stand in a header."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in text)


def warc_record(page_id, url, payload: bytes, refers_to) -> bytes:
    """A response with its payload, or a revisit of another page's without it."""
    digest = base32_sha1(payload)
    revisit = refers_to is not None
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{i}/{digest}')}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)),
              ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        fields.append(("WARC-Target-URI", _header_value(url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(refers_to)),
                   ("X-Refers-To-Page", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of an uncompressed record; a response's payload must fit its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not the start of a record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return fields, payload


# --- over tables -----------------------------------------------------------------------------------

def with_originals(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id with the same payload, or null.

    Only payloads that occur more than once enter the join, so the pages are shuffled only if
    those are too many to be sent to every task.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = materialize(
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("original"))
        .where("n > 1 and original is not null").drop("n"), "originals")
    refers = F.when(~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES,
                   least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write all pages to archives in the shared folder; returns path, records and bytes of each.

    Each attempt of a task writes files of its own. The list of archives is stored with the
    attempts that won, so files of lost attempts are never read.
    """
    folder = scratch(pages.sparkSession, "archives")

    def run(batches):
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        held, index, size = [], [], 0

        def close():
            name = f"{uuid.uuid4().hex}.zip"
            index.sort()
            with system.open_output_stream(f"{base}/{name}") as out:
                for piece in zip_stored([(RECORDS, b"".join(held)), (INDEX, "".join(index).encode())]):
                    out.write(piece)
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64()),
                 pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in slices(batches):
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                packed = gzip.compress(warc_record(page_id, url, payload, refers), 3, mtime=0)
                line = {"offset": size, "length": len(packed), "filename": RECORDS}
                index.append(f"{_header_value(url or '-').replace(' ', '%20')} 20000101000000 {json.dumps(line)}\n")
                held.append(packed)
                size += len(packed)
                if size >= archive_bytes:
                    yield close()
                    held, index, size = [], [], 0
        if index:
            yield close()

    return materialize(with_originals(pages, least_bytes).mapInArrow(
        run, "path string, records long, bytes long"), "archive-list")


def index_ranges(archives: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Byte ranges of neighbouring records: path, start, size, and the records' ends inside."""

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = fs.FileSystem.from_uri(path)
                rows = []
                with system.open_input_file(place) as file:
                    members = stored_members(file)
                    base = members[RECORDS][0]
                    lines = _read(file, *members[INDEX]).decode().split("\n")[:-1]
                found = sorted((x["offset"], x["length"]) for x in
                               (json.loads(line.split(" ", 2)[2]) for line in lines))
                for offset, length in found:
                    last = rows[-1] if rows else None
                    end = base + offset + length
                    if last and last[0] + last[1][-1] == base + offset and end - last[0] <= range_bytes:
                        last[1].append(end - last[0])
                    else:
                        rows.append((base + offset, [length]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(rows)), pa.array([r[0] for r in rows], pa.int64()),
                         pa.array([r[1] for r in rows], pa.list_(pa.int64()))],
                        names=["path", "start", "ends"])

    return archives.select("path").mapInArrow(run, "path string, start long, ends array<long>")


def read_records(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives, fetched by range.

    Columns: page_id, url, record_type, payload_bytes, payload_digest (both of the full payload),
    refers_to and, if asked for, payload (null for revisits).
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(kinds + [("payload", pa.binary())] * payloads)

    def run(batches):
        for batch in batches:
            for path, start, ends in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    data = _read(file, start, ends[-1])
                rows = []
                for a, b in zip([0, *ends], ends):
                    fields, payload = parse_record(gzip.decompress(data[a:b]))
                    response = fields["WARC-Type"] == "response"
                    number = lambda k: int(fields[k]) if k in fields else None
                    rows.append((
                        number("X-Page-ID"), fields.get("WARC-Target-URI"), fields["WARC-Type"],
                        len(payload) if response else number("X-Payload-Length"),
                        fields["WARC-Payload-Digest"].removeprefix("sha1:"), number("X-Refers-To-Page"),
                        *([payload if response else None] * payloads)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    spelled = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
               "refers_to long" + ", payload binary" * payloads)
    ranges = materialize(index_ranges(archives), "ranges")
    spread = max(1, min(ranges.count(), 10 * archives.sparkSession.sparkContext.defaultParallelism))
    return ranges.repartition(spread).mapInArrow(run, spelled)


def archived(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Write all pages to archives and read every record back.

    A null html is an empty payload. Of pages with equal payloads, those with the smallest
    page_id are responses and the others revisit it; a group without any page_id is all
    response. Repeated rows with the smallest page_id are each a response. A null url or page_id
    stays null. Other columns are not read; an empty table gives no rows.
    """
    return read_records(write_archives(pages), payloads)
