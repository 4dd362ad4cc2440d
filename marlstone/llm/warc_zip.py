"""WARC records in ZIP packages: writing them, and reading single records by byte range without extraction.

A package holds ``archive/data.warc.gz`` (a gzip member for each record) and ``indexes/index.cdx`` (a line for each record: offset and
length within the archive), both stored without further compression. The reader parses the end-of-directory record, the
ZIP64 one if there is one, and the central directory; so it knows at which byte each stored member begins, reads the index, and then only
the ranges of the records.

Spark deals out pages to writers and records to readers. A writer streams into one package after the other, each of about
``package_bytes``, under a name that no other attempt uses; only packages that a finished task has named are read, so a lost executor leaves
at most an unused file. Files are opened through pyarrow.fs, by the scheme of the shared folder.

Of the records with the same payload of at least ``least_bytes`` bytes, the one with the largest page_id is the response; others
are revisits that name it and carry no payload. Equal digests are found on (digest, id) alone. Up to ``broadcast_rows`` digests that occur
again, payloads aren't shuffled either; beyond that, pages are dealt by digest and one of ``salts`` parts.

Edge cases: a null page is an empty payload; a null url is written as an empty one; a null page_id is a record without id and never what others revisit; pages that
repeat with the same id and payload are all responses; other columns are ignored; an empty table gives no package and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.shared import new_path, written

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
CLASHES = 1 << 16  # bytes at the end of a file in which a ZIP's last record begins


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member; a revisit has the response's headers, with the payload's full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parsed(member: bytes) -> dict:
    """Headers and payload of a record's gzip member."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    warc = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return {"warc": warc, "length": full, "payload": payload}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


class _Package:
    """A package that is being written, front to back."""

    def __init__(self, folder: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}.zip"
        system, path = _opened(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, page_id: int | None, member: bytes) -> None:
        self.lines.append(f"{'-' if page_id is None else page_id} {self.at} {len(member)}\n")
        self.member.write(member)
        self.at += len(member)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(self.lines))
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.at


def archived(pages: DataFrame, folder: str, *, least_bytes: int = 1000, package_bytes: int = 64 << 20, broadcast_rows: int = 200_000, salts: int = 32) -> DataFrame:
    """Writes the pages (page_id, url, html) below ``folder``; (package, records, bytes) for each package, already run."""
    page = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    ids = page.filter(F.octet_length("html") >= least_bytes).groupBy(F.col("digest").alias("same")).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    same = written(ids.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "same")
    if same.count() <= broadcast_rows:
        same = F.broadcast(same)
        page = page.join(same, page["digest"] == same["same"], "left")
    else:
        # Pages are shuffled by digest here; a digest that many pages share is dealt to ``salts`` parts.
        salt = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
        page = page.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        same = same.select("same", "first", salt).withColumnRenamed("salt", "its_salt")
        page = page.join(same, (F.col("digest") == F.col("same")) & (F.col("salt") == F.col("its_salt")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    page = page.select("page_id", "url", "html", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        package, done = None, []
        for batch in batches:
            for page_id, url, text, digest, refers_to in batch.itertuples(index=False, name=None):
                package = package or _Package(folder)
                package.add(whole(page_id), record(whole(page_id), url, text.encode("utf-8"), digest, whole(refers_to)))
                if package.at >= package_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pd.DataFrame(done, columns=["package", "records", "bytes"])

    # Ids as text: pandas would turn a column of ids with a null among them into floats and round large ones.
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    return written(page.withColumns(ids).mapInPandas(write, "package string, records long, bytes long"), "packages")


def directory(file, size: int) -> dict[str, tuple[int, int, int]]:
    """Member name -> (first byte of its data, length, method), from the central directory. ``file``: seek() and read()."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    base = max(0, size - CLASHES - 22)
    tail = read(base, size - base)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        where = read(base + end - 20, 20)
        if where[:4] == b"PK\x06\x07":
            z64 = read(struct.unpack_from("<Q", where, 8)[0], 56)
            length, start = struct.unpack_from("<QQ", z64, 40)
    entries, at, members = read(start, length), 0, {}
    while entries[at : at + 4] == b"PK\x01\x02":
        method = struct.unpack_from("<H", entries, at + 10)[0]
        packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", entries, at + 20)
        offset = struct.unpack_from("<I", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + n_name].decode()
        extra, k = entries[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # ZIP64: those of full size, packed size and offset that the entry leaves out, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(values) if full == 0xFFFFFFFF else full
                packed = next(values) if packed == 0xFFFFFFFF else packed
                offset = next(values) if offset == 0xFFFFFFFF else offset
            k += 4 + n
        local = struct.unpack("<HH", read(offset + 26, 4))
        members[name] = (offset + 30 + sum(local), packed, method)
        at += 46 + n_name + n_extra + n_note
    return members


def indexed(packages: DataFrame) -> DataFrame:
    """(package, at, length) of each record: where in the package file its bytes are."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["package"]:
                system, path = _opened(uri)
                with system.open_input_file(path) as file:
                    members = directory(file, file.size())
                    at, length, method = members[INDEX]
                    data = members[ARCHIVE]
                    if method or data[2]:
                        raise ValueError(f"{uri}: its members aren't stored")
                    file.seek(at)
                    lines = [line.split(" ") for line in file.read(length).decode().splitlines()]
                for k in range(0, len(lines), 50_000):
                    part = lines[k : k + 50_000]
                    yield pd.DataFrame({"package": uri, "at": [data[0] + int(x[1]) for x in part], "length": [int(x[2]) for x in part]})

    return packages.select("package").mapInPandas(locate, "package string, at long, length long")


def read_records(index: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record, by range reads."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file = None, None
        for batch in batches:
            for k in range(0, len(batch), 500):
                rows = []
                for package, at, length in batch.iloc[k : k + 500].itertuples(index=False, name=None):
                    if package != uri:
                        if file:
                            file.close()
                        system, path = _opened(package)
                        uri, file = package, system.open_input_file(path)
                    file.seek(at)
                    r = parsed(file.read(length))
                    warc, payload = r["warc"], r["payload"]
                    kind, named = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (hashlib.sha1(payload).hexdigest() != named or len(payload) != r["length"]):
                        raise ValueError(f"{package}: the record at {at} doesn't hold what its digest says")
                    rows.append((warc["WARC-Record-ID"], warc["WARC-Target-URI"], r["length"], named, kind, warc.get("WARC-Refers-To"), payload))
                yield pd.DataFrame(rows, columns=["record", "url", "payload_bytes", "payload_digest", "record_type", "refers", "payload"])
        if file:
            file.close()

    out = index.mapInPandas(read, "record string, url string, payload_bytes long, payload_digest string, record_type string, refers string, payload binary")
    number = lambda c: F.nullif(F.regexp_extract(c, "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
    return out.select(number("record").alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"), "payload")


def readers(total: int, cores: int, *, least_bytes: int = 4 << 20, most_bytes: int = 128 << 20, most: int = 50_000) -> int:
    """How many tasks read archives of so many bytes: enough for four rounds of the cores if each then has ``least_bytes``, as many as ``most_bytes`` a task ask for, ``most`` at most."""
    return max(1, min(most, max(min(-(-total // least_bytes), 4 * cores), -(-total // most_bytes))))


def round_trip(pages: DataFrame, *, parts: int | None = None, **options) -> DataFrame:
    """The pages' records, written as packages and read back.

    Readers are dealt records, not packages, in file order; their number, if not given, is that of ``readers``.
    """
    packages = archived(pages, new_path(pages.sparkSession, "packages"), **options)
    total = packages.agg(F.sum("bytes")).first()[0] or 0
    return read_records(indexed(packages).repartitionByRange(parts or readers(total, pages.sparkSession.sparkContext.defaultParallelism), "package", "at"))
