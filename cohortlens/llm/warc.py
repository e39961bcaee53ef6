"""Web archives with a two-level capture index.

Writing: every page becomes one gzip member of a WARC file; of equal payloads
only one is stored, the others refer to it.  Index: captures sorted by their
reversed-host URL key are cut into compressed blocks (level one); each index
file has a sparse directory with the first key of every block (level two).  A
lookup finds the index file, then the block by binary search, and reads just
the byte ranges of the block and of the record.

Archives and index live in the shared folder and are reached from the tasks
through ``pyarrow.fs``.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_tasks, fresh_path, stored

MIN_SHARED_BYTES = 1000
BLOCK_LINES = 256
MAX_ARCHIVE_BYTES = 1 << 30
#: Fixed capture time: the pages carry none.
CAPTURE_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE_SCHEMA = "url_key string, page_id long, archive string, offset long, length long"
RECORD_SCHEMA = ("page_id long, record_id string, record_type string, refers_id string, "
                 "payload_bytes long, payload_digest string")


def url_key(url: str | None) -> str:
    """``https://a.b.example/x?y`` -> ``example,b,a)/x?y``; null and junk get a defined key too."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").lower()
        port = parts.port
    except ValueError:
        return ")" + url.strip()
    name = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        name += f":{port}"
    return f"{name}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _open_fs(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _record(page_id, url, payload: bytes, digest: str, refers) -> bytes:
    """One WARC/1.1 record as a gzip member; ``refers`` is the page referred to or None."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {CAPTURE_DATE}",
            f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if url:
        # header values hold no line breaks
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers is not None:
        head.append(f"WARC-Refers-To: {_record_id(refers, digest)}")
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def parse_record(member: bytes) -> tuple[dict, bytes, int]:
    """Headers, payload and the HTTP length of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n")
                  if x.lower().startswith(b"content-length:"))
    return headers, payload, length


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_shared: int = MIN_SHARED_BYTES,
                   max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page; returns the captures (``CAPTURE_SCHEMA``), stored.

    Of pages with an equal payload of at least ``min_shared`` bytes the largest
    id becomes the response.  The id is found by a pre-aggregated maximum per
    digest, and only digests that occur twice are joined back (a hot digest is
    a skewed join key that adaptive execution splits).

    Null html is an empty payload, null url the empty key.  A null id loses
    against every other id; rows that repeat the largest id are all responses.
    A file name carries the task attempt, and only a finished attempt's names
    reach the capture table, so repeated attempts do no harm.
    """
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digest, size = F.sha1(F.encode("html", "UTF-8")), F.octet_length("html")
    shared = (rows.where(size >= min_shared).groupBy(digest.alias("digest"))
              .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
              .where("n > 1").select("digest", "holder"))
    tagged = (rows.withColumn("digest", digest).join(shared, "digest", "left")
              .select("page_id", "url", "html", "digest",
                      F.when((size >= min_shared) & F.col("holder").isNotNull()
                             & ~F.col("page_id").eqNullSafe(F.col("holder")),
                             F.col("holder")).alias("refers")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        out, name, offset, count = None, "", 0, 0
        for batch in batches:
            made = []
            for page_id, url, html, dig, refers in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or offset >= max_bytes:
                    if out is not None:
                        out.close()
                    name = f"{stem}-{count:04d}.warc.gz"
                    out, offset, count = fs.open_output_stream(
                        f"{root}/{name}", compression=None), 0, count + 1
                member = _record(page_id, url, html.encode(), dig, refers)
                out.write(member)
                made.append((url_key(url), page_id, f"{folder}/{name}", offset, len(member)))
                offset += len(member)
            keys, ids, names, offsets, lengths = zip(*made) if made else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ids, pa.int64()),
                 pa.array(names, pa.string()), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64())],
                names=["url_key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    return stored(few_tasks(tagged).mapInArrow(write, CAPTURE_SCHEMA), "captures")


class _Blocks:
    """One index file being read: its directory and the block read last."""

    def __init__(self, path: str):
        self.fs, root = _open_fs(path)
        self.file = self.fs.open_input_file(root)
        with self.fs.open_input_stream(root + ".dir") as f:
            entries = json.loads(f.read())
        self.first = [e[0].encode() for e in entries]
        self.place = [e[1:] for e in entries]
        self.at, self.lines = None, []

    def captures(self, key: str) -> Iterator[tuple]:
        """All captures of ``key``: binary search for its first block, then range reads."""
        want = key.encode()
        block = max(0, bisect.bisect_left(self.first, want) - 1)
        while block < len(self.first) and self.first[block] <= want:
            if self.at != block:
                offset, length = self.place[block]
                raw = zlib.decompress(self.file.read_at(length, offset))
                self.lines = [json.loads(x) for x in raw.decode().split("\n")]
                self.at, self.keys = block, [x[0].encode() for x in self.lines]
            i = bisect.bisect_left(self.keys, want)
            while i < len(self.keys) and self.keys[i] == want:
                yield tuple(self.lines[i])
                i += 1
            block += 1


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Sort captures by URL key into compressed blocks; returns ``(first, last, path)`` per file.

    One index file per range partition; ties of a hot key are split by archive
    and offset.  What the driver gets is one row per index file, that is one
    per partition of the sort, whatever the number of captures.
    """
    spark = captures.sparkSession
    folder = fresh_path(spark, "capture-index")
    order = ["url_key", "archive", "offset"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"index-{context.partitionId():05d}-{context.taskAttemptId()}"
        out, entries, offset, lines, last = None, [], 0, [], None

        def flush():
            nonlocal out, offset, lines
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}")
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            out.write(packed)
            entries.append((lines[0][0], offset, len(packed)))
            offset, lines = offset + len(packed), []

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns)):
                lines.append(line)
                last = line[0]
                if len(lines) == block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir") as f:
                f.write(json.dumps(entries).encode())
            yield pa.RecordBatch.from_pylist(
                [{"first": entries[0][0], "last": last, "path": f"{folder}/{name}"}])

    files = (captures.select("url_key", "page_id", "archive", "offset", "length")
             .repartitionByRange(*order).sortWithinPartitions(*order)
             .mapInArrow(write, "first string, last string, path string").collect())
    return sorted(((r["first"], r["last"], r["path"]) for r in files),
                  key=lambda x: (x[0].encode(), x[1].encode()))


def lookup(keys: DataFrame, index: list[tuple], key_col: str = "url_key") -> DataFrame:
    """Captures (``CAPTURE_SCHEMA``) of every distinct key of ``keys``.

    Each key goes to the index files whose key range holds it (a hot key spans
    several); the lookups of one index file are sorted, so a block is read once.
    """
    lasts = [x[1].encode() for x in index]
    firsts = [x[0].encode() for x in index]
    paths = [x[2] for x in index]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in batch.column(0).to_pylist():
                want = key.encode()
                i = bisect.bisect_left(lasts, want)
                while i < len(paths) and firsts[i] <= want:
                    out.append((paths[i], key))
                    i += 1
            files, found = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()),
                                              pa.array(found, pa.string())],
                                             names=["path", "key"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks = None, None
        for batch in batches:
            out = []
            for path, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != at:
                    at, blocks = path, _Blocks(path)
                for line in blocks.captures(key):
                    out.append(line)
                    if len(out) >= 10_000:
                        yield _capture_batch(out)
                        out = []
            yield _capture_batch(out)

    wanted = keys.select(F.col(key_col)).where(F.col(key_col).isNotNull()).distinct()
    return (few_tasks(few_tasks(wanted).mapInArrow(assign, "path string, key string")
                      .repartition("path").sortWithinPartitions("path", "key"))
            .mapInArrow(read, CAPTURE_SCHEMA))


def _capture_batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, ids, names, offsets, lengths = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array(names, pa.string()),
         pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
        names=["url_key", "page_id", "archive", "offset", "length"])


def read_records(captures: DataFrame) -> DataFrame:
    """Range-read and parse the records of ``captures`` (``RECORD_SCHEMA``).

    Captures are grouped by archive and 64 MB stretch and read in file order.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, file = None, None
        for batch in batches:
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != at:
                    if file is not None:
                        file.close()
                    fs, path = _open_fs(archive)
                    at, file = archive, fs.open_input_file(path)
                headers, payload, size = parse_record(file.read_at(length, offset))
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if headers["WARC-Type"] == "response":
                    digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                page = headers.get("Page-Id")
                out.append({"page_id": None if page is None else int(page),
                            "record_id": headers["WARC-Record-ID"],
                            "record_type": headers["WARC-Type"],
                            "refers_id": headers.get("WARC-Refers-To"),
                            "payload_bytes": size, "payload_digest": digest})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                [("page_id", pa.int64()), ("record_id", pa.string()),
                 ("record_type", pa.string()), ("refers_id", pa.string()),
                 ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]))

    stretch = F.floor(F.col("offset") / F.lit(1 << 26))
    return (few_tasks(captures.select("archive", "offset", "length")
                      .repartition("archive", stretch).sortWithinPartitions("archive", "offset"))
            .mapInArrow(read, RECORD_SCHEMA))


def resolve(records: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` per record.

    A revisit takes the payload facts from the response it refers to.
    """
    answers = (records.where("record_type = 'response'").groupBy("record_id")
               .agg(F.max("page_id").alias("refers_to"),
                    F.max("payload_bytes").alias("full_bytes"),
                    F.max("payload_digest").alias("full_digest")))
    revisits = few_tasks(records.where("record_type = 'revisit'")
                         .join(answers.withColumnRenamed("record_id", "refers_id"), "refers_id", "left")
                         .select("page_id", F.col("full_bytes").alias("payload_bytes"),
                                 F.col("full_digest").alias("payload_digest"), "record_type",
                                 "refers_to"))
    return records.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to")).unionByName(revisits)


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                       html_col: str = "html") -> DataFrame:
    """Write the archives and the index, then read every page's record back through the index."""
    captures = write_archives(pages, id_col, url_col, html_col)
    index = build_index(captures)
    found = lookup(captures, index)
    return resolve(stored(read_records(found), "records"))


def lookup_urls(spark: SparkSession, urls: DataFrame, index: list[tuple],
                url_col: str = "url") -> DataFrame:
    """Captures of the given URLs (``CAPTURE_SCHEMA``)."""
    keyed = F.udf(url_key, "string")
    return lookup(urls.select(keyed(F.col(url_col)).alias("url_key")), index)
