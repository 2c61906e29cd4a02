"""WARC records in ZIP packages: writing, locating members, range-reading records.

A package holds *stored* (uncompressed) members: ``archive/*.warc.gz`` (WARC
files whose records are separate gzip members; plain ``.warc`` files too) and ``indexes/*`` with
one CDXJ line per record (file name, offset and length within the
WARC member; gzip-packed indexes too). As nothing of these is compressed by ZIP itself, a record can be fetched
with one range request: central directory -> local header -> index -> record.
Other members may be compressed, they are never read. Packages of other
tools are read as well; without an index the records are found by walking the archive members.

Packages are written append-only (sizes follow in data descriptors), so they
can be put on object stores. ZIP64 fields are written when a size, offset or
count needs them, or always with ``force_zip64``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.attach import attach
from axiomata.llm.scratch import Scratch

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
_LIMIT32, _LIMIT16 = 0xFFFFFFFF, 0xFFFF
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


# == ZIP packages


class ZipWriter:
    """Append-only writer of stored members to a stream with ``write``."""

    def __init__(self, out, force_zip64: bool = False):
        self.out, self.at, self.force = out, 0, force_zip64
        self.entries: list[tuple[bytes, int, int, int]] = []
        self._open: list | None = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self._open = [raw, self.at, 0, 0]
        # flag 0x0808: sizes follow in a descriptor, names are UTF-8; sizes unknown here
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45, 0x0808, 0, 0, 0x21, 0, _LIMIT32, _LIMIT32, len(raw), len(extra)) + raw + extra)

    def write(self, data: bytes) -> None:
        self._open[2] = zlib.crc32(data, self._open[2])
        self._open[3] += len(data)
        self._put(data)

    def end(self) -> None:
        raw, offset, crc, size = self._open
        self._put(struct.pack("<4sIQQ", b"PK\7\x08", crc, size, size))
        self.entries.append((raw, offset, crc, size))
        self._open = None

    def close(self) -> None:
        start = self.at
        for raw, offset, crc, size in self.entries:
            wide = []
            for value in (size, size, offset):
                if self.force or value >= _LIMIT32:
                    wide.append(value)
            short = [_LIMIT32 if self.force or v >= _LIMIT32 else v for v in (size, size, offset)]
            extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
            self._put(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45, 0x0808, 0, 0, 0x21, crc, short[0], short[1], len(raw), len(extra), 0, 0, 0, 0, short[2]) + raw + extra)
        length, n, end = self.at - start, len(self.entries), self.at
        if self.force or n >= _LIMIT16 or length >= _LIMIT32 or start >= _LIMIT32:
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, length, start = _LIMIT16, _LIMIT32, _LIMIT32
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, length, start, 0))


def _end_record(source, size: int) -> tuple[int, int, int, int]:
    """(entries, length of the directory, its offset, bytes before the archive) from the end records."""
    tail_at = max(0, size - 22 - _LIMIT16)
    source.seek(tail_at)
    tail = source.read(size - tail_at)
    at = len(tail)
    while (at := tail.rfind(b"PK\5\6", 0, at + 3 if at < len(tail) else at)) >= 0:
        # the signature may also occur in the comment: the true record's comment ends the file
        if at + 22 <= len(tail) and at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] == len(tail):
            disk, first, n, length, start = struct.unpack("<HH2xHII", tail[at + 4 : at + 20])
            end = tail_at + at
            wide = n == _LIMIT16 or length == _LIMIT32 or start == _LIMIT32 or disk == _LIMIT16 or first == _LIMIT16
            if wide:
                source.seek(max(0, end - 20))
                locator = source.read(20)
                if end < 20 or locator[:4] != b"PK\6\7":
                    wide = False  # a plain archive may hold exactly these numbers
                else:
                    disk, record_at, disks = struct.unpack("<IQI", locator[4:20])
                    # what lies before the archive shifts the record: it ends where the locator begins
                    for where in (record_at, end - 20 - 56):
                        if not 0 <= where <= end - 76:
                            continue
                        source.seek(where)
                        record = source.read(56)
                        if record[:4] == b"PK\6\6":
                            break
                    else:
                        raise ValueError("no ZIP64 end of central directory")
                    disk, first, n, length, start = struct.unpack("<II8xQQQ", record[16:56])
                    if disks > 1:
                        raise ValueError("the archive is split over several files")
                    end = where
            if disk or first:
                raise ValueError("the archive is split over several files")
            before = end - length - start
            if before >= 0:
                return n, length, start + before, before
        if not at:
            break
        at -= 1
    raise ValueError("no end of central directory")


def zip_members(source, wanted=None) -> dict[str, tuple[int, int]]:
    """Name -> (offset of the data, length) of the stored members of an open random-access file.

    Compressed and encrypted members cannot be read by range and are left out; a name that
    ``wanted`` accepts raises ValueError instead. Raises ValueError too when the file is no ZIP package
    or its directory is damaged. Bytes before the archive and comments are allowed.
    """
    size = source.size()
    n, length, start, before = _end_record(source, size)
    source.seek(start)
    directory = source.read(length)
    found, p = {}, 0
    for _ in range(n):
        if directory[p : p + 4] != b"PK\1\2" or p + 46 > len(directory):
            raise ValueError("damaged central directory")
        flags, method = struct.unpack("<2H", directory[p + 8 : p + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<2I3H", directory[p + 20 : p + 34])
        offset, = struct.unpack("<I", directory[p + 42 : p + 46])
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        p += 46 + n_name + n_extra + n_comment
        while q + 4 <= len(extra):
            kind, width = struct.unpack("<2H", extra[q : q + 4])
            if kind == 1:
                values = list(struct.unpack(f"<{width // 8}Q", extra[q + 4 : q + 4 + width // 8 * 8]))
                try:
                    plain = values.pop(0) if plain == _LIMIT32 else plain
                    packed = values.pop(0) if packed == _LIMIT32 else packed
                    offset = values.pop(0) if offset == _LIMIT32 else offset
                except IndexError:
                    raise ValueError(f"short ZIP64 field of {name}") from None
            q += 4 + width
        if method or flags & 1:
            if wanted and wanted(name):
                raise ValueError(f"{name} is {'encrypted' if flags & 1 else 'compressed'}; only stored members can be read by range")
            continue
        offset += before
        if offset + 30 > size:
            raise ValueError(f"{name} lies outside the file")
        source.seek(offset)
        header = source.read(30)
        if header[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        own_name, own_extra = struct.unpack("<2H", header[26:30])
        at = offset + 30 + own_name + own_extra
        if at + plain > size:
            raise ValueError(f"{name} lies outside the file")
        found[name] = (at, plain)
    return found


def is_archive(name: str) -> bool:
    return bool(re.fullmatch(r"archive/.*\.warc(\.gz)?", name))


def is_index(name: str) -> bool:
    return bool(re.fullmatch(r"indexes/.*\.(cdxj?|idx)(\.gz)?", name))


def _read_parts(source, at: int, length: int, step: int = 1 << 20) -> Iterator[bytes]:
    while length > 0:
        source.seek(at)
        data = source.read(min(step, length))
        if not data:
            raise ValueError("the file ends inside a member")
        yield data
        at += len(data)
        length -= len(data)


def _index_lines(source, at: int, length: int, packed: bool) -> Iterator[str]:
    """Lines of an index member, read and unpacked in parts."""
    rest, opener = b"", zlib.decompressobj(31) if packed else None
    for data in _read_parts(source, at, length):
        while packed and data:
            rest += opener.decompress(data)
            data = opener.unused_data
            if opener.eof:
                opener = zlib.decompressobj(31)
        *lines, rest = (rest + (b"" if packed else data)).split(b"\n")
        yield from (x.decode() for x in lines)
    if rest:
        yield rest.decode()


def index_entries(source, members: dict[str, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """(absolute offset, length) of every record the indexes list; of every record of the archive members without an index."""
    archives = {n: m for n, m in members.items() if is_archive(n)}
    by_name = {n.removeprefix("archive/"): m for n, m in archives.items()}
    indexes = {n: m for n, m in members.items() if is_index(n) and not re.search(r"\.idx(\.gz)?$", n)}
    if not indexes:
        for name, (at, length) in sorted(archives.items()):
            yield from _walk(source, at, length, name.endswith(".gz"))
        return
    for name, (at, length) in sorted(indexes.items()):
        for line in _index_lines(source, at, length, name.endswith(".gz")):
            head, brace, body = line.partition("{")
            if not brace or head.startswith("!"):  # header lines
                continue
            entry = json.loads(brace + body)
            member = by_name.get(str(entry["filename"]).removeprefix("archive/")) if "filename" in entry else next(iter(by_name.values())) if len(by_name) == 1 else None
            begin, n = int(entry["offset"]), int(entry["length"])
            if member is None or begin < 0 or n < 0 or begin + n > member[1]:
                raise ValueError(f"{name} points outside the archive: {line[:200]}")
            yield member[0] + begin, n


def _walk(source, at: int, length: int, packed: bool) -> Iterator[tuple[int, int]]:
    """Records of an archive member without an index, one after the other."""
    begin, here = at, at
    if not packed:
        end = at + length
        while begin < end:
            source.seek(begin)
            head = source.read(min(1 << 16, end - begin)).partition(b"\r\n\r\n")[0]
            size = re.search(rb"(?im)^content-length:\s*(\d+)", head)
            if not size:
                raise ValueError("no WARC record")
            n = len(head) + 4 + int(size[1]) + 4
            yield begin, min(n, end - begin)
            begin += n
        return
    opener = zlib.decompressobj(31)
    for data in _read_parts(source, at, length):
        while data:
            opener.decompress(data)
            here += len(data) - len(opener.unused_data)
            data = opener.unused_data
            if opener.eof:
                yield begin, here - begin
                begin, opener = here, zlib.decompressobj(31)


# == WARC records


def digest_text(raw: bytes) -> str:
    """Bare upper-case base32 of a SHA-1."""
    return base64.b32encode(raw).decode()


def record_id(page_id, sha1: bytes) -> str:
    """The record id of the response for a page and payload, which revisits refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{sha1.hex()}')}>"


def warc_record(page_id, url: str | None, payload: bytes | None, size: int, sha1: bytes, refers_to, revisit: bool) -> bytes:
    """One gzip member with a response (HTTP head and payload) or revisit (HTTP head only, payload not needed) record."""
    block = _HTTP if revisit else _HTTP + payload
    own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'revisit/{page_id}/{url}/{sha1.hex()}')}>" if revisit else record_id(page_id, sha1)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {own}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or 'urn:none').encode('unicode_escape').decode()}",
        f"WARC-Payload-Digest: sha1:{digest_text(sha1)}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:  # escaped: an id of text may hold line ends
        head.insert(6, f"X-Page-Id: {quote(str(page_id), safe=' /:?=&')}")
    if revisit:
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(7, f"WARC-Refers-To: {record_id(refers_to, sha1)}")
        if refers_to is not None:
            head.insert(8, f"X-Refers-To-Page-Id: {quote(str(refers_to), safe=' /:?=&')}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record, gzip-packed or plain. Raises ValueError when it is damaged."""
    try:
        raw = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
    except zlib.error as e:
        raise ValueError(f"damaged WARC record: {e}") from None
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError("short WARC record")
    return headers, rest[:n]


# == Spark


def _roles(pages: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """(key, url, payload, size, digest, refers_to, revisit) of each page; one response for each payload.

    Roles are decided on ids and digests alone and joined back by both, so that the copies of
    one payload never meet in a task with their payloads.
    """
    base = pages.select(F.col("page_id").alias("key"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    pairs = base.filter(F.col("size") >= min_bytes).groupBy("digest", "key").agg(F.count("*").alias("ties"))
    pairs = scratch.keep(pairs, "pairs")
    first = pairs.groupBy("digest").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key")).alias("first"), F.sum("ties").alias("copies"), F.count("*").alias("ids"))
    first = scratch.keep(first.filter("copies > 1").select("digest", F.col("first.key").alias("first_key"), "ids"), "firsts")
    total = first.agg(F.sum("ids")).first()[0] or 0
    roles = attach(pairs, first, ["digest"], "ids", total)
    roles = scratch.keep(roles.select(F.col("digest").alias("d"), F.col("key").alias("k"), "first_key", "ties"), "roles")
    joined = base.join(roles, (base["digest"] == roles["d"]) & base["key"].eqNullSafe(roles["k"]) & (F.col("size") >= min_bytes), "left")
    same = F.col("d").isNull() | F.col("key").eqNullSafe(F.col("first_key"))
    out = joined.withColumn("revisit", ~same)
    if not roles.filter("ties > 1").isEmpty():  # repeated (page_id, payload): one of them is the response
        from pyspark.sql import Window

        tied = (F.coalesce("ties", F.lit(0)) > 1) & same
        rank = F.row_number().over(Window.partitionBy("digest", "key").orderBy("url"))
        out = out.filter(~tied).unionByName(out.filter(tied).withColumn("revisit", rank > 1))
    payload = F.when(~F.col("revisit"), F.col("payload")).alias("payload")
    return out.select("key", "url", payload, "size", "digest", F.when(F.col("revisit"), F.col("first_key")).alias("refers_to"), "revisit")


def write_packages(rows: DataFrame, root: str, roll_bytes: int = 256 << 20, roll_records: int = 200_000, force_zip64: bool = False) -> DataFrame:
    """Write ZIP packages below ``root``; lazily returns one (path, records, bytes) row for each.

    ``rows`` has key, url, payload, size, digest, refers_to, revisit. A package is
    closed at ``roll_bytes`` or ``roll_records``, so its index stays small. The
    names carry the task attempt: what a failed attempt leaves is never listed.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        task, done, seq = TaskContext.get(), [], 0
        package = out = None
        lines: list[str] = []

        def finish():
            nonlocal package, out
            package.end()
            package.begin(INDEX_MEMBER)
            for at in range(0, len(lines), 4096):
                package.write(("\n".join(lines[at : at + 4096]) + "\n").encode())
            package.end()
            package.close()
            out.close()
            done.append((name, len(lines), package.at))
            lines.clear()
            package = out = None

        for batch in batches:
            for key, url, payload, size, digest, refers, revisit in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if package is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{seq:04d}.wacz"
                    seq += 1
                    out = fs.open_output_stream(f"{base}/{name}")
                    package = ZipWriter(out, force_zip64)
                    package.begin(WARC_MEMBER)
                    begun = package.at
                packed = warc_record(key, url, payload, size, digest, refers, revisit)
                entry = {"url": url, "digest": f"sha1:{digest_text(digest)}", "filename": WARC_MEMBER.removeprefix("archive/"), "offset": package.at - begun, "length": len(packed)}
                lines.append(f"{quote(url or '-', safe=':/?=&,)(')} 19700101000000 {json.dumps(entry)}")
                package.write(packed)
                if package.at >= roll_bytes or len(lines) >= roll_records:
                    finish()
        if package is not None:
            finish()
        yield pa.RecordBatch.from_pydict(
            {"path": pa.array([f"{root}/{n}" for n, _, _ in done], pa.string()), "records": pa.array([r for _, r, _ in done], pa.int64()), "bytes": pa.array([b for _, _, b in done], pa.int64())}
        )

    return rows.mapInArrow(write, "path string, records long, bytes long")


def locate_records(packages: DataFrame, block_bytes: int = 4 << 20, block_records: int = 4096) -> DataFrame:
    """Ranges of records, from the central directories and indexes: (path, start, stops).

    ``start`` is the first record's absolute offset, ``stops`` the absolute
    ends of the range's records, which lie one after the other.
    """

    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    members = zip_members(source, lambda n: is_archive(n) or is_index(n))
                    ranges, start, own = [], 0, []
                    for begin, n in index_entries(source, members):
                        if own and (begin != own[-1] or begin + n - start > block_bytes or len(own) >= block_records):
                            ranges.append((path, start, own))
                            own = []
                        if not own:
                            start = begin
                        own.append(begin + n)
                        if len(ranges) >= 1024:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ranges), kinds)], names=["path", "start", "stops"])
                            ranges = []
                    if own:
                        ranges.append((path, start, own))
                    if ranges:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*ranges), kinds)], names=["path", "start", "stops"])

    return packages.select("path").mapInArrow(locate, "path string, start long, stops array<long>")


def _content(headers: dict[str, str], block: bytes) -> tuple[bytes, bool]:
    """Payload of a record, and whether its digest can be held against it."""
    if not headers.get("content-type", "").startswith("application/http"):
        return block, True
    head, _, body = block.partition(b"\r\n\r\n")
    return body, b"transfer-encoding" not in head.lower()


def read_records(ranges: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the ranges: page_id (text), url, payload_bytes, payload_digest, record_type, refers_to, record_id, refers_to_record, payload.

    Records of other writers have no page_id; a missing payload digest is computed for responses. A
    response's payload is digested again; a mismatch raises ValueError (not for chunked bodies, whose digest is of another form).
    """
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "payload"]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stops in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as source:
                    source.seek(start)
                    data = source.read(stops[-1] - start)
                rows, begin = [], start
                for stop in stops:
                    headers, block = parse_record(data[begin - start : stop - start])
                    begin = stop
                    kind, digest = headers.get("warc-type"), headers.get("warc-payload-digest")
                    body, comparable = _content(headers, block)
                    own = digest_text(hashlib.sha1(body).digest()) if kind in ("response", "resource") and comparable else None
                    digest = own if digest is None else digest.removeprefix("sha1:")
                    if own is not None and len(digest) == 32 and digest.upper() != own:
                        raise ValueError(f"{path}: damaged payload of record {headers.get('warc-record-id')}")
                    size = int(headers["x-payload-length"]) if "x-payload-length" in headers else len(body) if kind != "revisit" else None
                    text = lambda k: None if k not in headers else unquote(headers[k])
                    rows.append((text("x-page-id"), headers.get("warc-target-uri"), size, digest, kind, text("x-refers-to-page-id"), headers.get("warc-record-id"), headers.get("warc-refers-to"), body if with_payload and kind in ("response", "resource") else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=names)

    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.repartition(n, "path", "start").mapInArrow(
        read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string, refers_to_record string, payload binary"
    )


def archive_pages(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, **package) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to packages in the shared folder and list them.

    Null html is an empty payload. Equal payloads of ``min_revisit_bytes`` or
    more are stored once, with the smallest page_id (nulls last; of rows that
    repeat it, one); the others become revisits. An empty table gives no
    package. Other columns are ignored.
    """
    scratch = Scratch(spark, "warc")
    rows = _roles(pages, scratch, min_revisit_bytes)
    return scratch.keep(write_packages(rows, scratch.path("packages"), **package), "manifest")


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, **package) -> DataFrame:
    """Archive ``pages``, read the packages back by range, one row for each record."""
    kind = dict(pages.dtypes)["page_id"]
    found = read_records(locate_records(archive_pages(spark, pages, min_revisit_bytes, **package)))
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
