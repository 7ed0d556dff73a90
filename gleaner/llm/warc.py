"""WARC archives of pages, and their capture index merged from locally sorted runs.

1. Each page becomes a record, compressed on its own, of a response with the page's UTF-8 bytes as payload. Of
   records with equal payloads of at least ``least`` bytes the one with the largest page_id stays a response; the
   others become revisits that name it and keep the HTTP header alone.
2. Every task sorts its captures by URL key and time and writes one archive: a locally sorted run. Files are named by
   task attempt, and only those that a finished task reports count, so a repeated or lost task does no harm.
3. Archives are read back record by record. Each gives its run of the index.
4. Ranges of (URL key, time, page_id) are dealt out; within a range the runs are merged by a loser tree, so the table
   is globally ordered: the capture history of every URL. A URL with very many captures spans several ranges.

Null html is an empty payload, a null URL an empty one, a null page_id is kept as null. Rows with equal page_id and
payload are the same capture twice, neither a revisit of the other. Pages of any length are written whole. Times are
``FIRST_CAPTURE`` plus page_id seconds, as the table has none. Other columns are not used, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_batches, written
from gleaner.session import scratch_path

FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)
LEVEL = 5
CHUNK = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPAN = 2**31


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, no scheme, ``www`` or fragment, then path and query."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower() + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    return (FIRST_CAPTURE + timedelta(seconds=(page_id or 0) % _SPAN)).strftime("%Y-%m-%dT%H:%M:%SZ")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str, digest: str, size: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {quote(url, safe=''':/?#[]@!$&'()*+,;=%~''')}", f"WARC-Date: {capture_time(page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> dict:
    """Index fields of one decompressed record. A response's digest and length come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    return {
        "page_id": number("WARC-Record-ID"), "url_key": url_key(fields["WARC-Target-URI"]), "captured": fields["WARC-Date"],
        "record_type": fields["WARC-Type"], "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"),
    }


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write one archive per task below ``folder``; returns the table of finished files (path, records)."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("html")
    )
    same = rows.select("page_id", F.sha1("html").alias("sha1"), F.length("html").alias("size")).filter(F.col("size") >= least)
    holders = same.groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    revisits = same.join(holders, "sha1").filter("page_id <> holder").select(F.col("page_id").alias("again"), F.col("sha1").alias("seen"), "holder").distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                digest = digest_of(html)
                out.append((page_id, url, url_key(url), capture_time(page_id), digest, base64.b32decode(digest).hex(), len(html), record("response", page_id, url, digest, len(html), html)))
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "url", "url_key", "captured", "digest", "sha1", "size", "member"]
            )

    packed = rows.mapInArrow(pack, "page_id long, url string, url_key string, captured string, digest string, sha1 string, size long, member binary")
    joined = packed.join(revisits, (packed["page_id"] == revisits["again"]) & (packed["sha1"] == revisits["seen"]), "left")
    runs = joined.select("page_id", "url", "digest", "size", "member", "holder", "url_key", "captured").sortWithinPartitions("url_key", "captured", "page_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        context = TaskContext.get()
        path = f"{base}/run-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        files.create_dir(base, recursive=True)
        n = 0
        with files.open_output_stream(path, compression=None) as out:
            for batch in batches:
                for page_id, url, digest, size, member, holder in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    out.write(member if holder is None else record("revisit", page_id, url, digest, size, b"", holder))
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[1]]), pa.array([n])], names=["file", "records"])
        else:
            files.delete_file(path)

    return written(runs.mapInArrow(write, "file string, records long"), "archives")


_INDEX = "run string, url_key string, captured string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long"
_KINDS = {"string": pa.string(), "long": pa.int64()}
_INDEX_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in _INDEX.split(", ")])


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of every gzip member; one record is held at a time."""
    at, data = 0, b""
    while True:
        unpacker, content, begun = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if not data and not (data := stream.read(CHUNK)):
                if content:
                    raise ValueError("archive ends inside a record")
                return
            content.append(unpacker.decompress(data))
            at += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield begun, at - begun, b"".join(content)


def read_index(files: DataFrame, folder: str) -> DataFrame:
    """The capture index of the archives, one sorted run per file."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, base = _file_system(folder)
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, length, content in members(stream):
                        rows.append({"run": name, "offset": offset, "length": length} | parse_record(content))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_SCHEMA)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX_SCHEMA)

    # one file to a row and about one row to a task
    spread = files.repartitionByRange(max(1, files.count()), "file")
    return spread.select("file").mapInArrow(read, _INDEX)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers of their matches, so each step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for i in range(len(runs)):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.size) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to arrive waits here
                self.losers[node] = winner
                return
            if self._beats(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.runs and self.heads[(best := self.losers[0])] is not None:
            yield best, self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            self._play(best)


def merge_runs(index: DataFrame) -> DataFrame:
    """The index in global order of URL key, time and page_id: a loser tree over the runs of each range."""
    placed = index.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("run", "url_key", "captured", "page_id")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=_INDEX_SCHEMA) if (batches := [b.cast(_INDEX_SCHEMA) for b in batches]) else None
        if table is None or not table.num_rows:
            return
        run = table["run"].to_pylist()
        keys = list(zip(table["url_key"].to_pylist(), table["captured"].to_pylist(), [-1 if p is None else p for p in table["page_id"].to_pylist()]))
        starts = [0] + [i for i in range(1, len(run)) if run[i] != run[i - 1]] + [len(run)]
        walk = [((keys[i], i) for i in range(a, b)) for a, b in zip(starts, starts[1:])]
        order = [head[1] for _, head in LoserTree(walk)]
        yield from table.take(pa.array(order)).combine_chunks().to_batches(max_chunksize=10_000)

    return placed.mapInArrow(merge, _INDEX)


def capture_history(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives (below the shared folder, if none is named) and return their merged index."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    files = write_archives(pages, folder, least)
    return merge_runs(written(read_index(files, folder), "runs"))


def page_records(pages: DataFrame) -> DataFrame:
    return capture_history(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")
