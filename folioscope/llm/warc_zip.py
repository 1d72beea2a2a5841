"""WARC records in ZIP packages: writing, and range reading without extraction.

``write_archives`` writes records as gzip members into a WARC file, a CDXJ line per record into
an index, and both as stored members into a ZIP package with a datapackage.json.  Equal
payloads (by SHA-256 and length) of a least size are written once, as the response of the
largest id; the others become revisit records that refer to it.

``read_archives`` opens nothing as a whole: it reads a package's last bytes for the end
record, the ZIP64 locator and directory if there are any, then the central directory, then
the indexes, and from there each slice of records as one byte range.  Index slices are dealt
over the cluster, so a large package is read by many tasks.  Packages of other writers may hold
any number of archives below ``archive/``, gzipped by record or plain, and indexes below
``indexes/`` in CDXJ or CDX, stored, deflated or gzipped.  What can't be read by ranges (an
archive that isn't stored, an index that names an archive that isn't there, a package without
an index) is an error and not an empty result.

Packages are written below the folder all executors share, under names of their own; the
names come back as rows of the finished tasks, so what a lost or repeated task left behind is
never read.

Defined cases: null html is an empty payload; a null page_id comes back as null and is a
revisit if an equal payload has an id; of repeated rows with the largest id all are
responses; null URLs leave the target out and line breaks in URLs are percent-encoded; empty
tables make no package and give an empty result; further columns are not read.
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
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.scratch import cut, new_path, small

#: Payloads of at least so many bytes are written once.
MIN_BYTES = 0
#: Bytes of a package, about, and records of an index slice.
ARCHIVE_BYTES, SLICE = 32 << 20, 2_000

#: Bytes that a slice reads, and that lie unused between two of its records, at most.
SLICE_BYTES, GAP_BYTES = 32 << 20, 1 << 20

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
DATE = "2020-01-01T00:00:00Z"
_DIGITS_ONLY = str.maketrans("", "", "-:TZ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def sort_key(url: str) -> str:
    """The host's labels from the last to the first, and what follows it: the order of an index."""
    host, slash, rest = url.partition("://")[2].partition("/")
    return (",".join(reversed(host.lower().split("."))) + ")" + slash + rest.lower()).replace(" ", "%20") if host else "-"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, dict]:
    """One gzip member holding a WARC record, and its index entry."""
    own = "" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = http + (b"Content-Length: %d\r\n\r\n" % len(payload)) + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{own}>", f"WARC-Date: {DATE}"]
    target = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    if target is not None:
        head.append("WARC-Target-URI: " + target)
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    shown = f"sha1:{digest(payload)}"
    head += [f"WARC-Payload-Digest: {shown}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    data = gzip.compress("\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)
    return data, {"url": target or "", "mime": "warc/revisit" if refers_to is not None else "text/html", "status": "200", "digest": shown, "filename": DATA.rpartition("/")[2]}


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _joined(chunks: bytes) -> bytes:
    """The body that was sent in chunks."""
    out, at = [], 0
    while (end := chunks.find(b"\r\n", at)) >= 0 and (n := int(chunks[at:end].split(b";")[0] or b"0", 16)):
        out.append(chunks[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out)


def parse(member: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload's length of a record, gzipped or not; a revisit has no payload, but its length if its HTTP headers say so."""
    member = bytes(member)
    raw = gzip.decompress(member) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, headers = _headers(head)
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    body, told = rest[: int(headers["content-length"])], None
    if headers.get("content-type", "").startswith("application/http"):
        inner, _, body = body.partition(b"\r\n\r\n")
        told = _headers(inner)[1]
        if headers["warc-type"] != "revisit" and told.get("transfer-encoding", "").lower() == "chunked":
            body = _joined(body)
    if headers["warc-type"] == "revisit":
        return headers, b"", int((told or {}).get("content-length") or 0)
    return headers, body, len(body)


def checked(headers: dict[str, str], payload: bytes) -> str:
    """The payload's digest as the record gives it, in base32; raises ValueError where the payload has another."""
    given = headers.get("warc-payload-digest")
    if given is None:
        return digest(payload)
    name, _, shown = given.partition(":")
    if headers["warc-type"] != "revisit" and name.lower() in hashlib.algorithms_guaranteed and not name.lower().startswith("shake"):
        own = hashlib.new(name.lower(), payload)
        if shown.upper() not in (base64.b32encode(own.digest()).decode(), base64.b32encode(own.digest()).decode().rstrip("="), own.hexdigest().upper()):
            raise ValueError("a payload differs from its digest")
    return shown


def _open(uri: str):
    from pyarrow import fs

    found, path = fs.FileSystem.from_uri(uri)
    return found, path


def zip_members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """(place of the data, its length, compression method) of each member of the ZIP package ``f``, by ranges; ZIP64 or not."""

    def at(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    tail_at = max(0, size - 65_557)
    tail = at(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = at(tail_at + end - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (where,) = struct.unpack_from("<Q", locator, 8)
        record64 = at(where, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack_from("<QQQ", record64, 32)
    directory, out, pos = at(start, length), {}, 0
    for _ in range(count):
        if directory[pos : pos + 4] != b"PK\x01\x02":
            raise ValueError("a broken central directory")
        method, packed, plain, n_name, n_extra, n_note = struct.unpack_from("<H8xIIHHH", directory, pos + 10)
        (local,) = struct.unpack_from("<I", directory, pos + 42)
        name = directory[pos + 46 : pos + 46 + n_name].decode("utf-8", "replace")
        extra = directory[pos + 46 + n_name : pos + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        n_local = struct.unpack_from("<HH", at(local, 30), 26)
        out[name] = (local + 30 + sum(n_local), packed, method)
        pos += 46 + n_name + n_extra + n_note
    return out


def write_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """path, records of each package written for the rows of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("mark", F.sha2("payload", 256))
    rows = rows.withColumn("n", F.octet_length("payload"))
    heads = rows.where(F.col("n") >= min_bytes).groupBy("mark", "n").agg(F.max("page_id").alias("head"), F.count("*").alias("rows")).where("rows > 1 AND head IS NOT NULL")
    heads = cut(heads.select("mark", F.col("n").alias("size"), "head"), "heads")
    rows = rows.join(small(heads, 128), (rows["mark"] == heads["mark"]) & (rows["n"] == F.col("size")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head"))
    folder = new_path(pages.sparkSession, "warc")

    def run(batches):
        data, index, n = io.BytesIO(), [], 0

        def flush():
            package = io.BytesIO()
            with zipfile.ZipFile(package, "w", zipfile.ZIP_STORED) as z:
                held = {DATA: bytes(data.getbuffer()), INDEX: "".join(sorted(index)).encode()}
                about = [{"name": k.rpartition("/")[2], "path": k, "hash": "sha256:" + hashlib.sha256(v).hexdigest(), "bytes": len(v)} for k, v in held.items()]
                held[PACKAGE] = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": about}).encode()
                for name, content in held.items():
                    z.writestr(name, content)
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            found, inner = _open(path)
            found.create_dir(inner.rpartition("/")[0], recursive=True)
            with found.open_output_stream(inner) as out:
                out.write(package.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(index)], pa.int64())], ["path", "records"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, body, refers_to = (batch.column(k)[i].as_py() for k in range(4))
                member, entry = record(page_id, url, body, refers_to)
                entry |= {"offset": str(data.tell()), "length": str(len(member))}
                index.append(f"{sort_key(entry['url'])} {DATE.translate(_DIGITS_ONLY)} {json.dumps(entry)}\n")
                data.write(member)
                if data.tell() >= archive_bytes:
                    yield flush()
                    data, index = io.BytesIO(), []
        if index:
            yield flush()

    return cut(rows.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(run, "path string, records long"), "packages")


_SLICES = "path string, base long, entries array<struct<offset: long, length: long>>"
_RECORDS = "path string, record_type string, record_id string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def index_lines(name: str, content: bytes):
    """(archive, offset, length) of each line of an index in CDXJ or CDX."""
    for line in (gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content).decode("utf-8", "replace").splitlines():
        if "{" in line:
            entry = json.loads(line[line.index("{") :])
            yield entry["filename"], int(entry["offset"]), int(entry["length"])
        elif line.strip() and not line.startswith((" CDX", "!")):
            fields = line.split(" ")
            if len(fields) < 11:
                raise ValueError(f"{name}: a line of an unknown kind")
            yield fields[10], int(fields[9]), int(fields[8])


def located(f, size: int):
    """(place of the archive, records) for each slice of the package ``f``: neighbouring records of one archive, (offset, length) each."""
    members = zip_members(f, size)
    indexes = sorted(n for n in members if n.startswith("indexes/") and n.lower().endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")))
    if not indexes:
        raise ValueError("no index")
    found: dict[str, set[tuple[int, int]]] = {}
    for name in indexes:
        at, n, method = members[name]
        f.seek(at)
        content = f.read(n)
        if method not in (0, 8):
            raise ValueError(f"{name}: compressed in an unknown way")
        for archive, offset, length in index_lines(name, zlib.decompress(content, -15) if method == 8 else content):
            found.setdefault(archive, set()).add((offset, length))
    for archive, records in sorted(found.items()):
        at, n, method = members.get(f"archive/{archive}", members.get(archive, (0, 0, None)))
        if method != 0:
            raise ValueError(f"{archive}: {'not in the package' if method is None else 'not stored, so it has no ranges'}")
        held: list[tuple[int, int]] = []
        for offset, length in sorted(records):
            if offset + length > n:
                raise ValueError(f"{archive}: a record beyond its end")
            end = sum(held[-1]) if held else offset
            if held and (len(held) == SLICE or offset - end > GAP_BYTES or offset + length - held[0][0] > SLICE_BYTES):
                yield at, held
                held = []
            held.append((offset, length))
        if held:
            yield at, held


def _slices(batches):
    kinds = pa.schema([("path", pa.string()), ("base", pa.int64()), ("entries", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())])))])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            found, path = _open(uri)
            with found.open_input_file(path) as f:
                for base, records in located(f, f.size()):
                    rows = [{"path": uri, "base": base, "entries": [{"offset": a, "length": n} for a, n in records]}]
                    yield pa.RecordBatch.from_pylist(rows, schema=kinds)


def _read(with_payload: bool):
    def run(batches):
        names = [x.split()[0] for x in _RECORDS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                found, path = _open(row["path"])
                with found.open_input_file(path) as f:
                    entries, rows = row["entries"], []
                    first = entries[0]["offset"]
                    f.seek(row["base"] + first)
                    data = memoryview(f.read(entries[-1]["offset"] + entries[-1]["length"] - first))
                    for e in entries:
                        headers, payload, n = parse(data[e["offset"] - first : e["offset"] - first + e["length"]])
                        shown = checked(headers, payload)
                        rows.append((row["path"], headers["warc-type"], headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), payload if with_payload else None, n, shown))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_archives(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of each package of ``packages`` (path)."""
    spark = packages.sparkSession
    width = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices = packages.select("path").repartition(width).mapInArrow(_slices, _SLICES)
    return slices.repartition(width).mapInArrow(_read(with_payload), _RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    records = read_archives(write_archives(pages), with_payload=False)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) AS BIGINT)")
    return records.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), heads AS (SELECT h, n, max(page_id) AS head FROM p GROUP BY h, n),
digits AS (
  SELECT p.*, head, to_base(CAST('0x' || h[1:10] AS BIGINT), 32, 8) || to_base(CAST('0x' || h[11:20] AS BIGINT), 32, 8)
         || to_base(CAST('0x' || h[21:30] AS BIGINT), 32, 8) || to_base(CAST('0x' || h[31:40] AS BIGINT), 32, 8) AS d
  FROM p JOIN heads USING (h, n)
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       translate(d, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM digits
"""
