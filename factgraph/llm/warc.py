"""WARC archives of pages, with an index that comes first and range reads that follow it.

``write_archives`` works in three steps, and no payload is ever shuffled:

1. Every task writes its rows as response records, each a gzip member of its own, and
   returns an index row for each: file, offset, length, record id, URL, digest, size.
2. The index alone, 150 bytes a record, says which payloads repeat and which record of
   each is the first.
3. Files that hold repeats are written anew: what stays is copied, in coalesced reads
   of sorted byte ranges and without unpacking, and a repeat becomes a revisit record
   that names the first one. Other files stay as they are.

``read_records`` sorts any selection of the index by file and offset, reads neighbouring
ranges in one go, and unpacks the members; ``resolve`` gives revisits the payload's size,
digest and page of the record that they name.

A digest that holds more than a thousandth of all records is one of at most a thousand,
so their first records are broadcast; others meet theirs in a shuffle join, where none
is larger than that. A record's place in its file tells equal rows apart: of repeated
rows one is the response. Rows without page_id come last. A null or empty html is an
empty payload, a null URL no header; line breaks and other controls in URLs are escaped
in the archive, and whole in the index. A page of any length is one member. An empty
table gives an empty index and no file. Files of lost task attempts are in no index.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import byte_slices, open_fs, partitions, shared_dir, stored

FILE_BYTES = 64 << 20
#: Neighbouring ranges with a smaller gap are read at once, up to so many bytes.
GAP, READ_BYTES = 64 << 10, 8 << 20
#: A key with more than one in so many rows is hot; there are fewer such keys than this.
HOT = 1000
INDEX = "file string, offset long, length long, record_id string, page_id long, url string, digest binary, size long, record_type string, refers_to string"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to string, stated_digest string, payload binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def record(kind: str, headers: list[tuple[str, str | None]], block: bytes, date: str) -> bytes:
    """One record as a gzip member; headers without value are left out."""
    lines = [("WARC-Type", kind), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None)
    return member(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n")


def header_url(url: str | None) -> str | None:
    return None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def response(record_id: str, url: str | None, digest: bytes, payload: bytes, date: str) -> bytes:
    headers = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", header_url(url)), ("WARC-Payload-Digest", f"sha256:{digest.hex()}"), ("Content-Type", "application/http; msgtype=response")]
    return record("response", headers, http_head(len(payload)) + payload, date)


def revisit(record_id: str, url: str | None, digest: bytes, size: int, first: str, date: str) -> bytes:
    headers = [
        ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", header_url(url)), ("WARC-Payload-Digest", f"sha256:{digest.hex()}"),
        ("WARC-Refers-To", f"<{first}>"), ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record("revisit", headers, http_head(size), date)


class Archive:
    """A file below ``folder`` that gets its name when it is whole."""

    def __init__(self, folder: str, date: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        self.fs, self.path = open_fs(self.uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out, self.size = self.fs.open_output_stream(self.path + ".tmp"), 0
        self.add(record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date))

    def add(self, raw: bytes) -> int:
        """The offset at which ``raw`` begins."""
        self.out.write(raw)
        self.size += len(raw)
        return self.size - len(raw)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.path + ".tmp", self.path)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema)


_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.binary()), ("size", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string())])
_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("stated_digest", pa.string()), ("payload", pa.binary())])


def _write_responses(pages: DataFrame, folder: str, date: str, file_bytes: int) -> DataFrame:
    def write(batches):
        own, rows = None, []
        for whole in batches:
            for part in byte_slices(whole, 2):
                for page, url, payload in zip(*(part.column(k).to_pylist() for k in range(3))):
                    own = own or Archive(folder, date)
                    digest, name = hashlib.sha256(payload).digest(), f"urn:uuid:{uuid.uuid4()}"
                    raw = response(name, url, digest, payload, date)
                    rows.append((own.uri, own.add(raw), len(raw), name, page, url, digest, len(payload), "response", None))
                    if own.size >= file_bytes:
                        own.close()
                        yield _rows(rows, _INDEX)
                        own, rows = None, []
        if own:
            own.close()
            yield _rows(rows, _INDEX)

    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    return raw.mapInArrow(write, INDEX)


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with ``table``, whose keys are unique, however often ``rows`` (a written table) has one of them."""
    total = rows.count()
    hot = rows.filter(F.col(key).isNotNull()).groupBy(key).count().filter(F.col("count") * HOT > total).select(key)
    some = F.broadcast(hot).join(table, key, how)
    return rows.join(F.broadcast(some), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key, how))


def _ranges(fs, path: str, wanted: list[tuple[int, int]]):
    """The bytes of each (offset, length), which are sorted; neighbours share a read."""
    with fs.open_input_file(path) as src:
        at = 0
        while at < len(wanted):
            end, start, stop = at + 1, wanted[at][0], sum(wanted[at])
            while end < len(wanted) and wanted[end][0] - stop <= GAP and sum(wanted[end]) - start <= READ_BYTES:
                stop = max(stop, sum(wanted[end]))
                end += 1
            src.seek(start)
            raw = src.read(stop - start)
            for offset, length in wanted[at:end]:
                yield raw[offset - start : offset - start + length]
            at = end


def _by_file(batches):
    """The rows of each file in turn, as dicts; rows come sorted by file and offset."""
    file, held = None, []
    for b in batches:
        for part in byte_slices(b, b.schema.get_field_index("file"), rows=1024):
            for r in part.to_pylist():
                if r["file"] != file and held:
                    yield file, held
                    held = []
                file = r["file"]
                held.append(r)
    if held:
        yield file, held


def write_archives(pages: DataFrame, min_bytes: int = 100, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in the shared folder; their index, as a written table.

    Of records with equal payloads of ``min_bytes`` or more, the one with the smallest
    page_id is a response and the others revisit it; ``refers_to`` is its record id.
    """
    spark = pages.sparkSession
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    folder = shared_dir(spark, "warc")
    index = stored(_write_responses(pages, folder, date, file_bytes), "warc-index")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "file", "offset", "record_id")
    firsts = index.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.record_id").alias("first_id"))
    repeats = stored(lookup(index.select("digest", "file", "offset", "record_id"), firsts, "digest").filter("record_id <> first_id").select("file", "offset", "first_id"), "warc-repeats")
    touched = repeats.select("file").distinct()

    def rewrite(batches):
        for file, rows in _by_file(batches):
            fs, path = open_fs(file)
            kept = _ranges(fs, path, [(r["offset"], r["length"]) for r in rows if r["first_id"] is None])
            own, out = Archive(folder, date), []
            for r in rows:
                again = r["first_id"] is not None
                raw = revisit(r["record_id"], r["url"], r["digest"], r["size"], r["first_id"], date) if again else next(kept)
                out.append((own.uri, own.add(raw), len(raw), r["record_id"], r["page_id"], r["url"], r["digest"], r["size"], "revisit" if again else "response", r["first_id"]))
            own.close()
            yield _rows(out, _INDEX)

    # A file's index rows are few; it is rewritten by one task, and files are of one size.
    work = index.join(touched, "file", "left_semi").drop("refers_to", "record_type").join(repeats, ["file", "offset"], "left")
    n = max(partitions(spark), touched.count())
    anew = stored(work.repartition(n, "file").sortWithinPartitions("file", "offset").mapInArrow(rewrite, INDEX), "warc-rewritten")
    whole = stored(index.join(touched, "file", "left_anti").select(*anew.columns).unionByName(anew), "warc-index")
    whole.archive_folder = folder

    def remove(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                fs, path = open_fs(file)
                if fs.get_file_info(path).type != pa.fs.FileType.NotFound:
                    fs.delete_file(path)
            yield b

    touched.mapInArrow(remove, "file string").count()
    return whole


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record's member; ValueError if it is not whole."""
    unpacked = zlib.decompress(raw, 31)
    head, _, rest = unpacked.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if not version.startswith("WARC/1.") or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record is not whole")
    return headers, rest[:size]


def read_records(index: DataFrame) -> DataFrame:
    """record_id, page_id, url, record_type, refers_to, stated_digest, payload of the records that rows of the index name.

    Type, ids and payload are the archive's own; page_id and url are the index's. A revisit's payload is null.
    """
    spark = index.sparkSession
    total = index.agg(F.sum("length")).first()[0] or 0
    n = max(partitions(spark), -(-total // FILE_BYTES))

    def read(batches):
        for file, rows in _by_file(batches):
            fs, path = open_fs(file)
            out, held = [], 0
            for r, raw in zip(rows, _ranges(fs, path, [(r["offset"], r["length"]) for r in rows])):
                headers, block = parse(raw)
                name, first = headers["warc-record-id"][1:-1], headers.get("warc-refers-to")
                if name != r["record_id"]:
                    raise ValueError(f"{file} has another record at {r['offset']} than its index says")
                payload = None if headers["warc-type"] == "revisit" else block.partition(b"\r\n\r\n")[2]
                out.append((name, r["page_id"], r["url"], headers["warc-type"], first and first[1:-1], headers["warc-payload-digest"].removeprefix("sha256:"), payload))
                held += len(payload or b"")
                if held >= READ_BYTES or len(out) >= 4096:
                    yield _rows(out, _RECORD)
                    out, held = [], 0
            yield _rows(out, _RECORD)

    slim = index.select("file", "offset", "length", "record_id", "page_id", "url")
    return slim.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of all records of read_records.

    Size and digest are those of the payload that was read, for a revisit its response's.
    A revisit whose response is not among the records, or has another digest, is an error.
    """
    slim = stored(records.select("record_id", "page_id", "record_type", F.col("refers_to").alias("first"), "stated_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")), "warc-read")
    wrong = F.raise_error(F.concat(F.lit("payload and stated digest differ: "), F.col("record_id")))
    held = slim.filter("record_type = 'response'").withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(wrong))
    again = stored(slim.filter("record_type = 'revisit'").select("record_id", "page_id", "record_type", "first", "stated_digest"), "warc-revisits")
    firsts = held.select(F.col("record_id").alias("first"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    met = lookup(again, firsts, "first", "left").withColumn("payload_digest", F.when(F.col("payload_digest") == F.col("stated_digest"), F.col("payload_digest")).otherwise(wrong))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return held.withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(met.select(*out))
