"""Web archives packed into ZIP files: written by Spark tasks, found by their directories and read by ranges.

An archive is a ZIP file with two stored (uncompressed) members: `archive/data.warc.gz`, in which every record is a gzip member
of its own, and `indexes/index.cdxj`, one line per record with its place. A reader takes the end-of-directory record, the ZIP64
one where it applies, then the central directory, the local header of a stored member and the index; every record is then one
range of the file. Nothing is unpacked to disk, and reads of neighbouring records are merged up to a fixed size.

Of records with equal payloads of at least `min_bytes`, that with the largest page_id is a response with the payload; the others
are revisits with the HTTP header only, which keeps the payload's length, and the digest. Smaller payloads are all responses.
Equal payloads are found by digest, pre-aggregated before the shuffle; a payload with a third of all pages makes one row of the
digest table, and Spark splits the pages' side of the join.

A null html is an empty payload. Repeated rows are separate records; rows that repeat the largest page_id of their payload are
all responses. A null page_id never is the largest unless the payload has no other; its record has an id without number. An
empty table gives no archives and no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import files
from vitalgrid.llm.common import cut_lineage, staging_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task starts its next archive, and bytes fetched by one range read.
ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 4 << 20
RANGES_PER_TASK = 2
#: Fixed values of the ZIP format: signatures, record layouts and the mark of a field that moved to the ZIP64 extra.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
END_FORM, LOCATOR64_FORM, END64_FORM = struct.Struct("<4s4H2LH"), struct.Struct("<4sLQL"), struct.Struct("<4sQ2H2L4Q")
CENTRAL_FORM, LOCAL_FORM = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
FULL32, FULL16, EXTRA64 = 0xFFFFFFFF, 0xFFFF, 1
#: Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


# --- ZIP directories ----------------------------------------------------------------------------------------------------------

def _end_of_directory(file: Any, size: int) -> tuple[int, int, int]:
    """Entries, place and length of the central directory."""
    tail_at = max(0, size - END_FORM.size - FULL16 - LOCATOR64_FORM.size)
    tail = file.read_at(size - tail_at, tail_at)
    i = tail.rfind(END, 0, len(tail) - END_FORM.size + 4)
    while i >= 0 and i + END_FORM.size + struct.unpack_from("<H", tail, i + 20)[0] != len(tail):
        i = tail.rfind(END, 0, i)  # the signature's bytes inside a comment
    if i < 0:
        raise ValueError("no end of a ZIP directory")
    _, _, _, _, entries, length, at, _ = END_FORM.unpack_from(tail, i)
    j = i - LOCATOR64_FORM.size
    if j >= 0 and tail[j: j + 4] == LOCATOR64:
        _, _, end64, _ = LOCATOR64_FORM.unpack_from(tail, j)
        fields = END64_FORM.unpack(file.read_at(END64_FORM.size, end64))
        if fields[0] != END64:
            raise ValueError("no ZIP64 end of directory where its locator points")
        entries, length, at = fields[7], fields[8], fields[9]
    return entries, at, length


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Fields at their 32-bit limit, replaced from the ZIP64 extra in order."""
    i, wide = 0, b""
    while i + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, i)
        if kind == EXTRA64:
            wide = extra[i + 4: i + 4 + n]
        i += 4 + n
    out, k = [], 0
    for value in fields:
        if value == FULL32 and k + 8 <= len(wide):
            value = struct.unpack_from("<Q", wide, k)[0]
            k += 8
        out.append(value)
    return out


def members(file: Any) -> list[Member]:
    """All entries of the central directory."""
    entries, at, length = _end_of_directory(file, file.size())
    directory, i, out = file.read_at(length, at), 0, []
    for _ in range(entries):
        head = CENTRAL_FORM.unpack_from(directory, i)
        if head[0] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, size, n_name, n_extra, n_comment, header = head[4], head[8], head[9], head[10], head[11], head[12], head[16]
        name = directory[i + CENTRAL_FORM.size: i + CENTRAL_FORM.size + n_name]
        extra = directory[i + CENTRAL_FORM.size + n_name: i + CENTRAL_FORM.size + n_name + n_extra]
        size, packed, header = _wide(extra, [size, packed, header])
        out.append(Member(name.decode("utf-8" if head[3] & 0x800 else "cp437"), method, size, packed, header))
        i += CENTRAL_FORM.size + n_name + n_extra + n_comment
    return out


def data_start(file: Any, member: Member) -> int:
    """Where the bytes of a stored member begin; the local header's own lengths count."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = LOCAL_FORM.unpack(file.read_at(LOCAL_FORM.size, member.header))
    if head[0] != LOCAL:
        raise ValueError("no local header where the directory points")
    return member.header + LOCAL_FORM.size + head[9] + head[10]


def record_places(file: Any) -> Iterator[tuple[int, int]]:
    """(place in the file, length) of every record of an archive, by its indexes."""
    found = {m.name: m for m in members(file)}
    for name, member in found.items():
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            lines = file.read_at(member.size, data_start(file, member)).decode().splitlines()
            starts: dict[str, int] = {}
            for line in lines:
                entry = json.loads(line.split(" ", 2)[2])
                if entry["filename"] not in starts:
                    starts[entry["filename"]] = data_start(file, found[f"archive/{entry['filename']}"])
                yield starts[entry["filename"]] + int(entry["offset"]), int(entry["length"])


# --- records ------------------------------------------------------------------------------------------------------------------

def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(page: int | None) -> str:
    return f"<urn:x-page:{'' if page is None else page}>"


def _page(name: str) -> int | None:
    number = name.removeprefix("<urn:x-page:").removesuffix(">")
    return int(number) if number else None


def pack_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_named(page)}", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def _fields(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines.decode().split("\r\n")[1:])}


def parse_record(packed: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and the payload that the record holds."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, _fields(http), payload


class ArchiveWriter:
    """Streams records into one archive."""

    def __init__(self, uri: str) -> None:
        self.out = files.create(uri)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, page: int | None, url: str | None, packed: bytes) -> None:
        entry = {"url": url, "filename": DATA.split("/")[1], "offset": str(self.size), "length": str(len(packed)), "page": page}
        self.lines.append(f"{page} - {json.dumps(entry)}\n")
        self.data.write(packed)
        self.size += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as index:
            index.write("".join(self.lines).encode())
        self.zip.close()
        self.out.close()


# --- jobs ---------------------------------------------------------------------------------------------------------------------

def with_roles(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, refers_to, revisit)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    equal = rows.where(F.length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    equal = equal.where("n > 1 AND last IS NOT NULL").select(F.col("sha1").alias("_sha1"), "last")
    joined = rows.join(equal, F.col("sha1") == F.col("_sha1"), "left")
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z",
                   folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages; the manifest (path, n_records). Tasks write under names of their own, and the manifest says which count."""
    folder = files.make_folder(folder or staging_path(pages.sparkSession, "archives"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, uri = None, ""

        def done() -> pd.DataFrame:
            writer.close()
            return pd.DataFrame({"path": [uri], "n_records": [len(writer.lines)]})

        for batch in batches:
            for page, url, payload, refers, revisit in batch.itertuples(index=False):
                if writer is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.wacz"
                    writer = ArchiveWriter(uri)
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                writer.add(page, url, pack_record(page, url, bytes(payload), refers, bool(revisit), date))
                if writer.size >= archive_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    rows = with_roles(pages, min_bytes, id_col, url_col, html_col)
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"), "revisit")
    return cut_lineage(rows.mapInPandas(write, "path string, n_records long"), "archive-manifest")


def locate(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, lengths): runs of neighbouring records, of at most `range_bytes` unless one record is longer."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, lengths, start, end = [], [], 0, -1
                with files.open_ranges(path) as file:
                    for at, length in record_places(file):
                        if lengths and (at != end or end + length - start > range_bytes):
                            rows.append((path, start, lengths))
                            lengths = []
                        if not lengths:
                            start = at
                        lengths.append(length)
                        end = at + length
                if lengths:
                    rows.append((path, start, lengths))
                yield pd.DataFrame(rows, columns=["path", "at", "lengths"])

    # A number of its own keeps Spark from merging the few, small rows into one task.
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInPandas(find, "path string, at long, lengths array<long>")


def read_records(ranges: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record; payloads are checked against their digest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rows in batch.groupby("path", sort=False):
                with files.open_ranges(path) as file:
                    for at, lengths in zip(rows["at"], rows["lengths"]):
                        raw, i, out = file.read_at(int(sum(lengths)), int(at)), 0, []
                        for length in lengths:
                            warc, http, payload = parse_record(raw[i: i + length])
                            i += length
                            named = warc["warc-payload-digest"].removeprefix("sha1:")
                            revisit = warc["warc-type"] == "revisit"
                            if not revisit and digest(payload) != named:
                                raise ValueError(f"payload of {warc['warc-record-id']} in {path} does not fit its digest")
                            n = int(http["content-length"]) if revisit else len(payload)
                            out.append((_page(warc["warc-record-id"]), warc.get("warc-target-uri"), n, named, warc["warc-type"], _page(warc["warc-refers-to"]) if revisit else None))
                        frame = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                        yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    spread = ranges.repartition(max(1, ranges.count() // RANGES_PER_TASK), "path", "at")
    return spread.mapInPandas(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return read_records(cut_lineage(locate(write_archives(pages, min_bytes)), "record-ranges"))
