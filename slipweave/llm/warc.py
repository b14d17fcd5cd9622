"""WARC archives and revisit resolution.

Pages are written as gzip-per-record WARC/1.1 files into the shared folder. The
archives are read back, record headers (never payloads) are shuffled by payload
digest, each revisit is joined to its original response, and every archive is
rewritten with fresh headers, a revisit without its payload.

Archives of others are read, too, compressed by record or plain. Of records with
one digest the smallest (page_id, file, offset) among the responses is the original;
the other responses become revisits, and revisits that came in name it: a record
without payload never becomes a response. A revisit whose original is in none of
the archives keeps the headers that name it. Other kinds of records (warcinfo,
request, metadata, ...) are copied as they are. Record ids are kept, since other
records may name them.

Only files named in a committed manifest table count, so half-written files of
lost tasks are ignored. A file is closed at `roll_bytes`, which bounds the work
of one reading task.

Defined cases: null html is an empty payload; null url has no target header; a
null page_id, as in archives of others, sorts last and is returned as null; equal
rows are separate records; no rows give no records; other columns are ignored;
a record that is cut off or differs from its digest raises.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import materialize, new_path, remove, temporary

HEADERS = (
    "file string, offset long, page_id long, uri string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, record_id string, date string"
)
#: What resolve() says of a record.
DECISION = ["record_type", "refers_to", "payload_digest", "refers_id", "refers_uri", "refers_date"]
_END = b"\r\n\r\n"
_STEP, _READ = 1 << 14, 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_REFERS = ("WARC-Refers-To", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date", "WARC-Refers-To-Source-Row")


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(
    kind: str, page_id: int | None, uri: str | None, payload: bytes, sha: str, date: str, refers: dict[str, str | None] | None = None,
    size: int | None = None, record_id: str | None = None, http: bytes | None = None,
) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head, which holds the full length."""
    if http is None:
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}".encode()
    block = http + _END + (b"" if kind == "revisit" else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id or f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if page_id is not None:
        head.append(f"WARC-Source-Row: {page_id}")
    if uri is not None:
        head.append(f"WARC-Target-URI: {_one_line(uri)}")
    if kind == "revisit":
        head.append(f"WARC-Profile: {_PROFILE}")
        head += [f"{name}: {_one_line(value)}" for name, value in (refers or {}).items() if value is not None]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + _END + block + _END


class Record:
    """One record taken apart: header fields by lower-case name, HTTP head, payload."""

    def __init__(self, raw: bytes):
        head, end, rest = raw.partition(_END)
        version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not end or not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        self.raw, self.fields, name = raw, {}, ""
        for line in lines:
            if line[:1] in (" ", "\t"):  # goes on from the line before
                self.fields[name] += " " + line.strip()
            else:
                name, _, value = line.partition(":")
                name = name.strip().lower()
                self.fields[name] = value.strip()
        size = int(self.fields["content-length"])
        block = rest[:size]
        if len(block) != size or rest[size:] != _END:
            raise ValueError(f"damaged record {self.get('WARC-Record-ID')}")
        self.kind = self.get("WARC-Type")
        http = "application/http" in (self.get("Content-Type") or "")
        self.http, _, self.payload = block.partition(_END) if http else (b"", b"", block)

    def get(self, name: str) -> str | None:
        return self.fields.get(name.lower())

    def length(self) -> int | None:
        """Bytes of the payload; those a revisit's HTTP head tells."""
        if self.kind != "revisit":
            return len(self.payload)
        found = re.search(rb"(?i)(?:^|\r\n)content-length:\s*(\d+)", self.http)
        return int(found[1]) if found else None

    def digest(self) -> str | None:
        """Of the payload as it is stored; of a revisit as it is told."""
        told = (self.get("WARC-Payload-Digest") or "").partition(":")
        said = told[2].upper() if told[0].lower() == "sha1" else None
        if self.kind == "revisit":
            return said
        mine = digest(self.payload)
        if said not in (None, mine) and not (b"chunked" in self.http.lower() and said == digest(unchunked(self.payload))):
            raise ValueError(f"payload digest differs in {self.get('WARC-Record-ID')}")
        return mine


def unchunked(payload: bytes) -> bytes:
    """The body of a chunked transfer; what is not one, as it is."""
    out, at = [], 0
    while found := re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r\n").match(payload, at):
        size = int(found[1], 16)
        if not size:
            return b"".join(out)
        out.append(payload[found.end():found.end() + size])
        at = found.end() + size + 2
    return payload


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each gzip member; holds one record and one read at a time."""
    buffered, at, offset = memoryview(b""), 0, 0
    while True:
        unzip, parts, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if at >= len(buffered):
                buffered, at = memoryview(stream.read(_READ)), 0
            if not buffered:
                if used:
                    raise ValueError(f"archive ends inside the record at {offset}")
                return
            step = buffered[at:at + _STEP]  # what is left over is copied: little at a time
            parts.append(unzip.decompress(step))
            taken = len(step) - len(unzip.unused_data)
            at, used = at + taken, used + taken
        yield offset, b"".join(parts)
        offset += used


def plain(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of an archive that is not compressed."""
    held, offset = b"", 0
    while True:
        while (end := held.find(_END)) < 0 and (more := stream.read(_READ)):
            held += more
        if not held.strip():
            return
        found = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", held[:max(end, 0)])
        if not found:
            raise ValueError(f"archive ends inside the record at {offset}")
        size, parts, have = end + 4 + int(found[1]) + 4, [held], len(held)
        while have < size and (more := stream.read(_READ)):
            parts.append(more)
            have += len(more)
        held = b"".join(parts)
        if have < size:
            raise ValueError(f"archive ends inside the record at {offset}")
        yield offset, held[:size]
        held, offset = held[size:], offset + size


def records(store, path: str) -> Iterator[tuple[int, Record]]:
    """(offset, record) of an archive, compressed by record or plain."""
    with store.open_input_stream(path, compression=None) as stream:
        zipped = stream.read(2) == b"\x1f\x8b"
    with store.open_input_stream(path, compression=None) as stream:
        for offset, raw in (members if zipped else plain)(stream):
            yield offset, Record(raw)


class _Writer:
    """Writes members and starts a new file when one is full."""

    def __init__(self, folder: str, level: int, roll_bytes: int):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.level, self.roll, self.out, self.size, self.files = level, roll_bytes, None, 0, []

    def add(self, raw: bytes) -> None:
        if self.out is None or self.size >= self.roll:
            self.close()
            name = f"{uuid.uuid4().hex}.warc.gz"
            self.out, self.size = self.fs.open_output_stream(f"{self.folder}/{name}", compression=None), 0
            self.files.append(name)
        zip_ = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        data = zip_.compress(raw) + zip_.flush()
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
        self.out = None


def _int(value: str | None) -> int | None:
    return int(value) if value else None


def _make_folder(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)


def write_archives(pages: DataFrame, folder: str, level: int = 1, roll_bytes: int = 128 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """A response record per row; returns the committed table of file names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _make_folder(folder)
        out = _Writer(folder, level, roll_bytes)
        for batch in batches:
            for page_id, uri, html in zip(batch["page_id"], batch["url"], batch["html"]):
                body = b"" if html is None else html.encode("utf-8", "surrogatepass")
                out.add(record("response", None if pd.isna(page_id) else int(page_id), uri, body, digest(body), date))
        out.close()
        yield pd.DataFrame({"file": out.files}, dtype=object)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialize(rows.mapInPandas(run, "file string"), "archives")


def _spread(files: DataFrame) -> DataFrame:
    """One archive per task; their number is that of the writing tasks."""
    return files.repartition(max(1, files.count()))


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """One row per response or revisit from the files themselves; response digests are recomputed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch["file"]:
                rows = []
                for offset, r in records(store, f"{base}/{name}"):
                    if r.kind not in ("response", "revisit"):
                        continue
                    rows.append((
                        name, offset, _int(r.get("WARC-Source-Row")), r.get("WARC-Target-URI"), r.length(), r.digest(), r.kind,
                        _int(r.get("WARC-Refers-To-Source-Row")), r.get("WARC-Record-ID"), r.get("WARC-Date"),
                    ))
                    if len(rows) >= 20_000:
                        yield _frame(rows)
                        rows = []
                yield _frame(rows)

    return _spread(files.select("file")).mapInPandas(run, HEADERS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in HEADERS.split(", ")])
    return frame.astype({"page_id": "Int64", "refers_to": "Int64", "offset": "int64", "payload_bytes": "Int64"})


def resolve(headers: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(file, offset, page_id, uri, payload_bytes) and DECISION for each record: of responses
    with one digest and at least `min_bytes` the smallest is the original. The minimum
    combines before the shuffle; only digests that repeat are joined back, a skewed one in splits."""
    key = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "offset", "record_id", "uri", "date")
    whole = F.col("record_type") == "response"
    first = (
        headers.where(~whole | (F.col("payload_bytes") >= min_bytes)).groupBy("payload_digest")
        .agg(F.min(F.when(whole, key)).alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    )
    joined = headers.join(first, "payload_digest", "left")
    itself = (F.col("file") == F.col("first.file")) & (F.col("offset") == F.col("first.offset"))
    big = ~whole | (F.col("payload_bytes") >= min_bytes)
    again = F.coalesce(big & F.col("first").isNotNull() & ~itself, F.lit(False))
    return joined.select(
        "file", "offset", "page_id", "uri", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise(F.col("record_type")).alias("record_type"),
        F.when(again, F.col("first.page_id")).otherwise(F.when(~whole, F.col("refers_to"))).alias("refers_to"),
        *[F.when(again, F.col(f"first.{c}")).alias(n) for c, n in (("record_id", "refers_id"), ("uri", "refers_uri"), ("date", "refers_date"))],
    )


def rewrite(decisions: DataFrame, source: str, target: str, archives: int, level: int = 5, roll_bytes: int = 128 << 20) -> DataFrame:
    """Copies each archive with fresh headers; payloads go from file to file."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        _make_folder(target)
        store, base = pafs.FileSystem.from_uri(source)
        told = {o: rest for o, *rest in zip(group["offset"], *(group[c] for c in DECISION))}
        out = _Writer(target, level, roll_bytes)
        for offset, r in records(store, f"{base}/{group['file'].iloc[0]}"):
            if r.kind not in ("response", "revisit"):
                out.add(r.raw)
                continue
            kind, row, sha, *names = told[offset]
            if names[0] is not None:
                refers = dict(zip(_REFERS, [*names, None if pd.isna(row) else str(int(row))]))
            else:  # the original is in none of the archives
                refers = {name: r.get(name) for name in _REFERS}
            out.add(record(
                kind, _int(r.get("WARC-Source-Row")), r.get("WARC-Target-URI"), r.payload, sha, r.get("WARC-Date") or "", refers,
                record_id=r.get("WARC-Record-ID"), http=r.http,
            ))
        out.close()
        return pd.DataFrame({"file": out.files}, dtype=object)

    picked = decisions.select("file", "offset", *DECISION)
    # Rows are small and archives are not: a fixed count keeps one archive from joining others in a task.
    picked = picked.repartition(2 * max(1, archives), "file")
    return materialize(picked.groupBy("file").applyInPandas(run, "file string"), "archives")


def deduplicate_archives(spark: SparkSession, files: DataFrame, source: str, target: str, min_bytes: int = 0) -> DataFrame:
    """Resolves the archives files(file) in a folder into another; returns their names. An
    archive without a response or revisit has nothing to resolve and is not rewritten."""
    headers = materialize(read_archives(files, source), "headers")
    return rewrite(resolve(headers, min_bytes), source, target, files.count())


def deduplicate(spark: SparkSession, pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """pages(page_id, url, html) -> one row per record of the deduplicated archives."""
    base = folder or new_path(spark, "warc")
    first = write_archives(pages, f"{base}/raw")
    second = deduplicate_archives(spark, first, f"{base}/raw", f"{base}/dedup", min_bytes)
    remove(spark, f"{base}/raw")
    if folder is None:
        temporary(spark, base)
    return read_archives(second, f"{base}/dedup")
