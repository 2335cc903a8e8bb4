"""WARC records in ZIP-packaged archives: written by tasks, then read by ranges without extraction.

An archive is a ZIP file with stored members: data files archive/*.warc.gz (one gzip member for each record) or
archive/*.warc, and indexes indexes/*.cdxj or *.cdx, plain or in gzip, whose lines are a sort key, a time and JSON with
the record's filename, offset and length. A reader fetches the ZIP's tail, follows the end record (and the ZIP64 locator
and end record, if any) to the central directory, finds the members' places, reads the indexes, and then fetches runs of
neighbouring records with one range read each. Archives of other writers may have several data files and indexes, records
without HTTP, chunked bodies, and digests of other kinds; a payload that doesn't match its digest is an error. The index
of one archive is held by one task. Records that no index names are not read.

Records of equal payloads (SHA-1 and SHA-256) of at least `revisit_bytes` bytes: the one with the smallest id is the
response, the others revisit it (rows that repeat that id with that payload are responses too); shorter payloads are all
responses. Only rows whose payload may be repeated are shuffled, and a frequent payload is dealt out in pieces.
Nulls: a null html is an empty payload, a null url an empty target, a null id sorts last and is written as a urn without
one. Ids may be of any type that a string can be cast to. An empty table gives no archive and an empty result. Other
columns are ignored. Archives are written under the shared folder under names of their own, and only those that a finished
task reports are read: a task that is lost leaves at most a file that nothing refers to. Files are opened through
pyarrow's file systems (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import BUCKETS, shared_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
INDEXES = (".cdxj", ".cdxj.gz", ".cdx", ".cdx.gz")
#: An archive is closed beyond this many bytes or records; a range read fetches about so many bytes; ranges of a task.
ARCHIVE_BYTES, ARCHIVE_RECORDS, RANGE_BYTES, TASK_RANGES = 256 << 20, 200_000, 4 << 20, 64
#: A payload of more than one in so many repeated rows is dealt out in pieces.
PIECES = 64


def _urn(ident) -> str:
    return "<urn:page>" if ident is None else f"<urn:page:{quote(str(ident), safe='')}>"


def _record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed. A revisit has the HTTP head but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(row['payload'])}\r\n\r\n".encode()
    body = head if row["revisit"] else head + row["payload"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: {_urn(row['id'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {row['target']}", f"WARC-Payload-Digest: sha1:{row['digest']}", "Content-Type: application/http; msgtype=response"]
    if row["revisit"]:
        lines += [f"WARC-Refers-To: {_urn(row['first'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def sort_key(url: str) -> str:
    """The key of an index line: the host's labels turned round, then the rest, without white space."""
    scheme, mark, rest = url.lower().partition("://")
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    key = ",".join(reversed(rest[:cut].split("."))) + ")" + (rest[cut:] or "/") if mark else scheme
    return "".join(quote(c) if c.isspace() else c for c in key) or "-"


def _write_archives(batches, folder: str, date: str):
    """Takes (id, url, payload, sha1 in hex, first id, revisit); yields (path, records) of each archive."""
    rows = (row for batch in batches for row in batch.to_pylist())
    row, stamp = next(rows, None), "".join(c for c in date if c.isdigit())[:14]
    while row is not None:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, index, at = f"{uuid.uuid4().hex}.zip", [], 0
        with store.open_output_stream(f"{base}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            with z.open(DATA, "w", force_zip64=True) as data:
                while row is not None and at < ARCHIVE_BYTES and len(index) < ARCHIVE_RECORDS:
                    row["payload"] = row["payload"].encode()
                    row["digest"] = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                    row["target"] = (row["url"] or "").replace("\r", "%0D").replace("\n", "%0A")
                    packed = gzip.compress(_record(row, date), 5, mtime=0)
                    data.write(packed)
                    about = {"url": row["target"], "mime": "warc/revisit" if row["revisit"] else "text/html", "status": "200", "digest": f"sha1:{row['digest']}", "length": str(len(packed)), "offset": str(at), "filename": DATA.rpartition("/")[2]}
                    index.append(f"{sort_key(row['target'])} {stamp} {json.dumps(about)}\n")
                    at += len(packed)
                    row = next(rows, None)
            z.writestr(INDEX, "".join(sorted(index)))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(index)], pa.int64())], names=["path", "records"])


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row; returns the archives: path, records. date: of all records, as rows have none."""
    spark, same = pages.sparkSession, ["sha1", "sha2"]
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("sha2", F.sha2("payload", 256))
    long = rows.where(F.octet_length("payload") >= revisit_bytes).select("id", *same)
    repeated = written(long.groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-payloads")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    # at most BUCKETS numbers are broadcast; rows of other numbers are written where they are read
    slot = F.pmod(F.xxhash64("sha1"), F.lit(BUCKETS)).alias("slot")
    slots = F.broadcast(repeated.select(slot).distinct())
    numbered = rows.select("*", slot)
    alone = numbered.join(slots, "slot", "left_anti").withColumn("first", F.lit(None).cast(rows.schema["id"].dataType)).withColumn("revisit", F.lit(False))
    pieces = (F.col("n") * PIECES / F.lit(max(total, 1))).cast("int") + 1
    hot = F.broadcast(repeated.where(F.col("n") * PIECES > total).select(*same, pieces.alias("pieces")))  # PIECES rows at most
    dealt = lambda df: df.join(hot, same, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    left = dealt(numbered.join(slots, "slot", "left_semi")).withColumn("piece", F.pmod(F.xxhash64("id", "url"), "pieces").cast("int"))
    right = dealt(repeated).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("n", "pieces").withColumn("found", F.lit(True))
    is_revisit = F.coalesce("found", F.lit(False)) & (F.octet_length("payload") >= revisit_bytes) & ~F.col("id").eqNullSafe(F.col("first"))
    columns = ["id", "url", "payload", "sha1", "first", "revisit"]
    planned = alone.select(*columns).unionByName(left.join(right, [*same, "piece"], "left").withColumn("revisit", is_revisit).select(*columns))
    folder = shared_path(spark, "warc")
    return written(planned.mapInArrow(lambda it: _write_archives(it, folder, date), "path string, records long"), "archives")


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Of an open ZIP file: name to (start of the data, stored bytes, method) of each member."""
    tail_at = max(0, size - 65_557)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, locator + 8)
        f.seek(end64)
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    f.seek(at)
    central, out, p = f.read(length), {}, 0
    for _ in range(count):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError("a damaged central directory")
        (method,) = struct.unpack_from("<H", central, p + 10)
        packed, plain, names, extras, notes = struct.unpack_from("<IIHHH", central, p + 20)
        (local,) = struct.unpack_from("<I", central, p + 42)
        name = central[p + 46 : p + 46 + names].decode()
        q, stop = p + 46 + names, p + 46 + names + extras
        while q + 4 <= stop:
            kind, n = struct.unpack_from("<HH", central, q)
            if kind == 1:  # ZIP64: only the fields that don't fit above, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", central, q + 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            q += 4 + n
        f.seek(local)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("a member's local header isn't where the directory says")
        local_names, local_extras = struct.unpack_from("<HH", head, 26)
        out[name] = (local + 30 + local_names + local_extras, packed, method)
        p = stop + notes
    return out


class _Span(io.RawIOBase):
    """A part of an open file, as a file of its own."""

    def __init__(self, f, start: int, size: int):
        self._f, self._at, self._end = f, start, start + size

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        self._f.seek(self._at)
        raw = self._f.read(min(len(out), self._end - self._at))
        out[: len(raw)] = raw
        self._at += len(raw)
        return len(raw)


def places(f, size: int) -> list[tuple[int, int]]:
    """(start, length) in an open archive of all records that its indexes name, in the order of members and places."""
    members, found = directory(f, size), {}

    def stored(name: str) -> tuple[int, int]:
        if name not in members or members[name][2] != 0:
            raise ValueError(f"{name} is missing or not stored")
        return members[name][:2]

    indexes = [m for m in members if m.startswith("indexes/") and m.endswith(INDEXES)]
    if not indexes:
        raise ValueError("no index")
    for m in indexes:
        lines = io.BufferedReader(_Span(f, *stored(m)), 1 << 20)
        for line in gzip.open(lines) if m.endswith(".gz") else lines:
            parts = line.split(b" ", 2)
            if len(parts) < 3 or line[:1] == b"!":  # empty lines and notes about the index
                continue
            x = json.loads(parts[2])
            name = x["filename"] if x["filename"].startswith("archive/") else f"archive/{x['filename']}"
            start, held = stored(name)
            at, n = int(x["offset"]), int(x["length"])
            if at < 0 or n <= 0 or at + n > held:
                raise ValueError(f"{name}: an index names bytes {at} to {at + n} of {held}")
            found[start + at] = n
    return sorted(found.items())


def _ranges(batches):
    """From archives to runs of neighbouring records: (path, start, lengths)."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                try:
                    records = places(f, f.size())
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
            starts, lengths, end, held = [], [], -1, 0
            for start, n in records:
                if start != end or held + n > RANGE_BYTES:
                    starts.append(start)
                    lengths.append([])
                    held = 0
                lengths[-1].append(n)
                end, held = start + n, held + n
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.list_(pa.int64()))], names=["path", "start", "lengths"])


def _id(urn: str | None) -> str | None:
    """The id in a urn that write_archives() made."""
    return unquote(urn[10:-1]) if urn and urn.startswith("<urn:page:") and urn.endswith(">") else None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that begins with white space continues the one before."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.removeprefix(" ")
    return out


def _unchunked(body: bytes) -> bytes:
    """A chunked body's bytes; one that isn't chunked, or is cut short, as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(digits, 16)
        except ValueError:
            return body
        if n < 0 or end + 2 + n > len(body):
            return body
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def _matches(digest: str, payload: bytes) -> bool:
    """Whether the payload has that labelled digest, in base32 or hex. Digests of unknown kinds are not checked."""
    label, _, value = digest.rpartition(":")
    kind = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "md5": hashlib.md5}.get(label.lower().replace("-", ""))
    raw = kind(payload).digest() if kind else b""
    return kind is None or value.rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex()


def parsed(record: bytes) -> dict:
    """The fields of one uncompressed record; a payload is checked against its digest, if it has one."""
    head, _, block = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("no WARC record is where the index says")
    fields = _fields(head)
    content, http = block[: int(fields["content-length"])], {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        top, _, content = content.partition(b"\r\n\r\n")
        http = _fields(top)
    kind, digest, ident = fields["warc-type"], fields.get("warc-payload-digest"), fields.get("warc-record-id")
    if kind == "revisit":
        declared = http.get("content-length", "").strip()
        content, size = None, int(declared) if declared.isdigit() else None
    else:
        sent = content
        if "chunked" in http.get("transfer-encoding", "").lower():
            content = _unchunked(sent)
        if digest and not _matches(digest, content) and not _matches(digest, sent):
            raise ValueError(f"{ident}: the payload doesn't match its digest")
        size = len(content)
    refers = fields.get("warc-refers-to")
    return {"id": _id(ident), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest and digest.removeprefix("sha1:"), "record_type": kind, "refers_to": _id(refers), "content": content, "record_id": ident, "refers_to_record": refers, "date": fields.get("warc-date")}


_RECORD = pa.schema([("id", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("content", pa.binary()), ("record_id", pa.string()), ("refers_to_record", pa.string()), ("date", pa.string())])


def _read(batches):
    for batch in batches:
        for row in batch.to_pylist():
            store, name = fs.FileSystem.from_uri(row["path"])
            with store.open_input_file(name) as f:
                f.seek(row["start"])
                raw = f.read(sum(row["lengths"]))
            found, at = [], 0
            for n in row["lengths"]:
                record = raw[at : at + n]
                found.append(parsed(gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record))
                at += n
            yield pa.RecordBatch.from_pylist(found, schema=_RECORD)


def archive_records(archives: DataFrame) -> DataFrame:
    """From a table with archives' paths to all records that their indexes name.

    id and refers_to (strings): of records that write_archives() made, else null. url, payload_bytes (null: a revisit that
    doesn't say), payload_digest (null: none; without its label for SHA-1), record_type, content (the payload's bytes;
    null: revisit), record_id, refers_to_record, date: as the record has them.
    """
    runs = written(archives.select("path").mapInArrow(_ranges, "path string, start long, lengths array<long>"), "ranges")
    tasks = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), runs.count() // TASK_RANGES)
    return runs.repartition(tasks).mapInArrow(_read, "id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, content binary, record_id string, refers_to_record string, date string")


def read_archives(archives: DataFrame, *, id_type: str = "long") -> DataFrame:
    """The records' id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null: revisit, or not UTF-8)."""
    ident = lambda c: F.col(c).try_cast(id_type).alias(c)
    return archive_records(archives).select(ident("id"), "url", "payload_bytes", "payload_digest", "record_type", ident("refers_to"), F.try_validate_utf8(F.col("content").cast("string")).alias("payload"))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read_archives(write_archives(pages, revisit_bytes=0)).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no SHA-1 and no base32; the query is tested against a brute-force version.
SQL: dict[str, str] = {}
