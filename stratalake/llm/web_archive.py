"""WARC archives of pages, and their capture index by an external merge of sorted runs.

`write_archives` makes one WARC/1.1 record per page, gzip member by member, in archives of about `ARCHIVE` bytes that
stand as rows of a Parquet table: Spark's committer keeps the archives of finished tasks only, on any file system that
Spark reaches. `save_archives` puts them down as .warc.gz files. Pages of equal payloads of at least `LEAST` bytes are
revisits of the one with the largest page_id. Only these groups' digests are joined to the pages, from a table of their
own, whose size decides between a broadcast and a shuffle that splits hot digests.

`capture_index` reads the archives back, checks every record, and sorts what it finds by url key and time: a task sorts
runs of at most `RUN` captures and writes them; the runs are dealt by ranges of the whole order (key, time, page, place
in the archive), so that a hot url is many ranges; in each range a loser tree merges the pieces of runs as they arrive.

Null html is an empty payload. A null or blank url is archived as `NO_URL`, its white space and control characters as
percent codes. Without a column of capture times, page_id stands for the seconds since 1970. A null page_id counts as
smaller than any other; where several rows share the largest page_id of a group, all of them are responses. An empty
table gives an empty index. Other columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import batches, drop_tables, materialize

#: Payloads below this many bytes are never revisits; bytes of an archive, about; captures of a run and of a range.
LEAST, ARCHIVE, RUN, RANGE = 1000, 1 << 20, 20_000, 200_000
NO_URL = "about:blank"
# Fixed values of the archive format (ISO 28500) and of HTTP.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class ArchiveError(ValueError):
    pass


def url_key(url: str) -> str:
    """Key that puts a host's and its parents' captures together: labels of the host from the last on, then path and query."""
    scheme, found, rest = url.partition("://")
    if not found:
        return ")" + url
    rest = rest.split("#", 1)[0]
    cut = re.search(r"[/?]", rest)
    host, path = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    return ",".join(reversed(host.lower().split("."))) + ")" + path


def _member(fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    head = VERSION + b"".join(b"%b: %b\r\n" % f for f in [*fields, (b"Content-Length", b"%d" % len(block))]) + b"\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(head) + packer.compress(block) + packer.compress(END) + packer.flush()


def _page_name(page_id: int | None) -> bytes:
    return b"<urn:page:%b>" % (b"" if page_id is None else b"%d" % page_id)


def _page_of(name: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d*)>", name)
    if not found:
        raise ArchiveError(f"record id {name!r}")
    return int(found[1]) if found[1] else None


def page_record(page_id: int | None, url: str | None, date: str, payload: bytes, refers_to: int | None) -> bytes:
    """The gzip member of a response, or of a revisit of the page `refers_to`."""
    url = url if url and url.strip() else NO_URL
    target = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url).encode("utf-8", "surrogatepass")
    digest = b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [
        (b"WARC-Type", b"response" if refers_to is None else b"revisit"), (b"WARC-Record-ID", _page_name(page_id)), (b"WARC-Date", date.encode()),
        (b"WARC-Target-URI", target), (b"Content-Type", b"application/http; msgtype=response"), (b"WARC-Payload-Digest", digest),
    ]
    if refers_to is not None:
        return _member([*fields, (b"WARC-Profile", PROFILE), (b"WARC-Refers-To", _page_name(refers_to))], http)
    return _member(fields, http + payload)


def _info(archive: str) -> bytes:
    block = b"software: stratalake\r\nformat: WARC File Format 1.1\r\n"
    return _member([(b"WARC-Type", b"warcinfo"), (b"WARC-Record-ID", b"<urn:archive:%b>" % archive.encode()), (b"WARC-Date", b"2000-01-01T00:00:00Z"), (b"Content-Type", b"application/warc-fields")], block)


def _fields(raw: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v.strip() for k, _, v in (line.partition(b":") for line in raw.split(b"\r\n"))}


def members(archive: bytes, step: int = 1 << 16) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of each gzip member."""
    view, at = memoryview(archive), 0
    while at < len(view):
        unpacker, parts, read = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if read >= len(view):
                raise ArchiveError(f"the member at {at} is cut off")
            try:
                parts.append(unpacker.decompress(view[read : read + step]))
            except zlib.error as error:
                raise ArchiveError(f"the member at {at}: {error}") from error
            read += len(view[read : read + step])
        read -= len(unpacker.unused_data)
        yield at, read - at, b"".join(parts)
        at = read


def read_record(content: bytes) -> tuple[dict[bytes, bytes], bytes]:
    """Fields and block of a record; its length must be as declared."""
    head, found, rest = content.partition(END)
    if not found or not head.startswith(VERSION):
        raise ArchiveError("no WARC/1.1 head")
    fields = _fields(head[len(VERSION) :])
    size = int(fields.get(b"content-length", b"-1"))
    if size < 0 or len(rest) != size + len(END) or rest[size:] != END:
        raise ArchiveError(f"a block of {size} bytes is declared, {len(rest) - len(END)} follow")
    return fields, rest[:size]


def read_capture(fields: dict[bytes, bytes], block: bytes) -> tuple:
    """(url_key, captured, page_id, url, payload_bytes, payload_digest, record_type, refers_to) of a response or revisit."""
    kind = fields[b"warc-type"].decode()
    head, found, payload = block.partition(END)
    size = int(_fields(head).get(b"content-length", b"-1"))
    digest = base64.b32decode(fields[b"warc-payload-digest"].removeprefix(b"sha1:"))
    if not found or (kind == "response" and (len(payload) != size or hashlib.sha1(payload).digest() != digest)):
        raise ArchiveError(f"the payload of {fields[b'warc-record-id']!r} isn't the declared one")
    url = fields[b"warc-target-uri"].decode("utf-8", "replace")
    refers = _page_of(fields[b"warc-refers-to"]) if kind == "revisit" else None
    captured = int(np.datetime64(fields[b"warc-date"].decode().removesuffix("Z"), "us").astype(np.int64))
    return url_key(url), captured, _page_of(fields[b"warc-record-id"]), url, size, digest.hex(), kind, refers


def with_referents(pages: DataFrame, captured: Column | None = None, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(page_id, url, captured, payload, refers_to) of every page, and the written table of repeated digests behind it."""
    time = F.unix_micros(captured) if captured is not None else F.coalesce(F.pmod(pages["page_id"].cast("long"), F.lit(4_000_000_000)), F.lit(0)) * 1_000_000
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"], time.alias("captured"), F.coalesce(pages["html"].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("newest"), F.count("*").alias("n"))
    repeated = materialize(groups.where("n > 1").select("digest", "size", "newest"))
    older = F.col("newest").isNotNull() & ~F.coalesce(F.col("page_id") >= F.col("newest"), F.lit(False))
    return rows.join(repeated, ["digest", "size"], "left").select("page_id", "url", "captured", "payload", F.when(older, F.col("newest")).alias("refers_to")), repeated


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE) -> DataFrame:
    """(archive, warc): archives of records, each led by a warcinfo record, as a written table."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        number, parts, size = 0, [], 0

        def closed() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join([_info(name), *parts])], pa.binary())], names=["archive", "warc"])

        for batch in batches(it):
            dates = [f"{d}Z" for d in np.datetime_as_string(batch.column("captured").to_numpy(zero_copy_only=False).astype("M8[us]"), unit="us")]
            for page_id, url, date, payload, refers_to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), dates, batch.column("payload").to_pylist(), batch.column("refers_to").to_pylist()):
                parts.append(page_record(page_id, url, date, payload, refers_to))
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield closed()
                    number, parts, size = number + 1, [], 0
        if parts:
            yield closed()

    return materialize(rows.select("page_id", "url", "captured", "payload", "refers_to").mapInArrow(run, "archive string, warc binary"), **{"compression": "none", "parquet.block.size": 16 << 20})


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, path, bytes): each archive as a file <archive>.warc.gz in a folder (a path or URI that pyarrow reaches) that all executors share.

    A file is written under another name and renamed, so that a task that is run again replaces it whole.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        system.create_dir(root, recursive=True)
        for batch in it:
            for name, warc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with system.open_output_stream(f"{root}/.{name}.{attempt}") as out:
                    out.write(warc)
                system.move(f"{root}/.{name}.{attempt}", f"{root}/{name}.warc.gz")
                yield pa.RecordBatch.from_pylist([{"archive": name, "path": f"{root}/{name}.warc.gz", "bytes": len(warc)}])

    return archives.select("archive", "warc").mapInArrow(run, "archive string, path string, bytes long")


CAPTURE = "url_key string, captured long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, size long"
_TYPES = {"string": pa.string(), "long": pa.int64()}
CAPTURE_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in CAPTURE.split(", "))])
#: The order of the index; the place in the archive makes it total.
ORDER = ["url_key", "captured", "page_id", "archive", "offset"]


def _order_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), CAPTURE_SCHEMA)], schema=CAPTURE_SCHEMA)


def capture_runs(archives: DataFrame, run_rows: int = RUN) -> DataFrame:
    """Captures of all archives, each task's in runs that are sorted."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in it:
            for k in range(batch.num_rows):
                name, warc = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                for offset, size, content in members(warc):
                    fields, block = read_record(content)
                    if fields[b"warc-type"] in (b"response", b"revisit"):
                        rows.append((*read_capture(fields, block), name, offset, size))
                        if len(rows) == run_rows:
                            yield _as_batch(sorted(rows, key=_order_key))
                            rows = []
        if rows:
            yield _as_batch(sorted(rows, key=_order_key))

    return archives.select("archive", "warc").mapInArrow(run, CAPTURE)


def loser_merge(runs: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of all keys of sorted runs in order, by a tournament whose inner nodes hold losers; ties to the earlier run."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    heads = [(0, run[0], r) if run else (1, None, r) for r, run in enumerate(runs)]  # (1, ...): at an end, after all others

    def first(a: int, b: int) -> bool:
        x, y = heads[a], heads[b]
        return x[0] < y[0] if x[0] or y[0] else x[1:] < y[1:]

    loser, winner = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if first(a, b) else (b, a)
    best = winner[1]
    while not heads[best][0]:
        yield best, at[best]
        at[best] += 1
        heads[best] = (0, runs[best][at[best]], best) if at[best] < len(runs[best]) else (1, None, best)
        node = (k + best) // 2
        while node:
            if first(loser[node], best):
                loser[node], best = best, loser[node]
            node //= 2


def merge_runs(runs: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """The captures of a written table of runs in one order over all partitions; part and seq number them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        kept, keys = [], []
        for batch in it:
            kept.append(batch)
            keys += list(map(_order_key, zip(*(c.to_pylist() for c in batch.columns))))
        if not keys:
            return
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
        pieces = [keys[a:b] for a, b in zip(cuts, cuts[1:])]
        order = np.fromiter((cuts[r] + k for r, k in loser_merge(pieces)), np.int64, len(keys))
        rows = pa.Table.from_batches(kept)
        for begin in range(0, len(order), 10_000):
            some = order[begin : begin + 10_000]
            out = rows.take(pa.array(some)).combine_chunks().to_batches()[0]
            seq = np.arange(begin, begin + len(some))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(some), part, np.int64)), pa.array(seq)], names=[*out.schema.names, "part", "seq"])

    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    return runs.repartitionByRange(parts, *ORDER).mapInArrow(run, f"{CAPTURE}, part long, seq long")


def capture_index(archives: DataFrame) -> DataFrame:
    """(place, url_key, captured, page_id, ..., archive, offset, size): all captures, place being the number in the whole order."""
    runs = materialize(capture_runs(archives))
    merged = materialize(merge_runs(runs))
    drop_tables(runs)
    parts = merged.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each range
    return merged.join(F.broadcast(before), "part").select((F.col("before") + F.col("seq") + 1).alias("place"), *CAPTURE_SCHEMA.names)


def archive_pages(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """The capture index of archives that are written from pages and read back."""
    rows, repeated = with_referents(pages, captured)
    archives = write_archives(rows)
    drop_tables(repeated)
    index = capture_index(archives)
    drop_tables(archives)
    return index


def capture_digests(pages: DataFrame) -> DataFrame:
    """The columns of the contract, and each capture's key, time and place in the order of the index."""
    return archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")
