"""Archives of published lesson pages (WARC 1.0, gzip member per record).

Pages are cut into ranges of ``page_id`` of about equal size; an id that fills several
ranges is spread over them by digest.  One task writes a range in order, as its sorted
rows stream in, and rolls to the next file by compressed size.  Headers, record ids and digests are
derived from the page alone, so a task that is run again writes the same bytes; it writes
under a temporary name and then renames.  What belongs to the archive is said by a
manifest, written by Spark after all files are there; readers open only files it lists.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import words as w
from terraloom.llm.fingerprint import range_of

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122: names that are URLs
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, n_records bigint, n_bytes bigint, sha256 string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str, turn: int) -> str:
    """The same for the same page; ``turn`` tells repeated rows of a page apart."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{payload_digest}/{turn}')}>"


def _header(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unheader(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id, url, payload: bytes, digest: str, turn: int, refers_to, revisit: bool, date: str) -> bytes:
    """One record: an HTTP response, or a revisit with the response's header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, turn)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 0)}"]
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def _stored(folder: str, name: str, content: bytes) -> None:
    """Write under a temporary name, then rename; a later attempt replaces the same bytes."""
    from pyarrow import fs

    if folder.startswith(("/", "file:/")):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(f"{path}/_temporary", recursive=True)
    store.create_dir(f"{path}/data", recursive=True)
    temporary = f"{path}/_temporary/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary) as out:
        out.write(content)
    store.move(temporary, f"{path}/data/{name}")


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, roll_bytes: int = 8 << 20, shard_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record per lesson page to ``folder`` (a URI that all executors reach, new for each call).

    pages: ``page_id`` bigint, ``url`` and ``html`` string; further columns are not read.
    The payload is the html in UTF-8, null counts as empty.  Of pages with equal payloads
    of at least ``min_revisit_bytes`` the one with the largest ``page_id`` is the response
    (of rows with the same id the first), the others become revisits of it; smaller
    payloads are all responses.  A null id comes last in the order and is response only if
    there is no other.  No page gives an archive without files.  A new file begins when a
    file has ``roll_bytes`` compressed bytes.
    """
    key = F.coalesce(F.col("page_id").cast("bigint"), F.lit(w.NULL_ID))
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), key.alias("key"), "url", body.alias("html"))
    shards = max(w.shuffle_width(pages), math.ceil(w.text_bytes(rows, "html") / shard_bytes))
    cuts = rows.agg(F.percentile_approx("key", [i / shards for i in range(shards)], 100 * shards), F.min("key")).first()
    times = Counter(cuts[0] or [])  # an id that fills several ranges is a start as often
    starts = sorted({*times, *([] if cuts[1] is None else [cuts[1]])}) or [0]
    spread = [max(1, times[x]) for x in starts]
    first = [0, *itertools.accumulate(spread)][:-1]
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("range").cast("int") + 1)
    rows = rows.select("*", F.unhex(F.sha1(F.encode("html", "utf-8"))).alias("digest"), range_of(F.col("key"), starts).alias("range"))
    turn = F.when(F.col("key") == at(starts), F.pmod(F.xxhash64("digest"), at(spread))).otherwise(at(spread) - 1)
    rows = rows.select("page_id", "key", "url", "html", "digest", (at(first) + turn).cast("int").alias("shard"))
    small = rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("digest", "shard").agg(F.max("page_id").alias("page_id"))
    best = small.groupBy("digest").agg(F.max("page_id").alias("response"))
    told = small.select("digest", "shard").join(best, "digest").select(
        F.col("response").alias("page_id"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"), "digest", "shard")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, response, seen, out, files, n = None, None, {}, {}, io.BytesIO(), 0, 0

        def roll() -> pa.RecordBatch:
            nonlocal out, files, n
            content, name = out.getvalue(), f"shard-{shard:07d}-{files:05d}.warc.gz"
            _stored(folder, name, content)
            row = (shard, name, n, len(content), hashlib.sha256(content).hexdigest())
            out, files, n = io.BytesIO(), files + 1, 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "n_records", "n_bytes", "sha256"])

        for batch in batches:
            page_ids, keys, urls, htmls, digests, places = (batch.column(c) for c in ("page_id", "key", "url", "html", "digest", "shard"))
            for i in range(batch.num_rows):
                page_id, raw = page_ids[i].as_py(), digests[i].as_py()
                if places[i].as_py() != shard:
                    if n:
                        yield roll()
                    shard, last, response, seen, files = places[i].as_py(), None, {}, {}, 0
                if keys[i].as_py() is None:  # the responses come before the pages of a shard
                    response[raw] = page_id
                    continue
                if keys[i].as_py() != last:
                    last, seen = keys[i].as_py(), {}
                payload, to = htmls[i].as_py().encode(), response.get(raw)
                turn = seen[page_id, raw] = seen.get((page_id, raw), -1) + 1
                revisit = len(payload) >= min_revisit_bytes and (page_id != to or turn > 0)
                text = record(page_id, urls[i].as_py(), payload, base64.b32encode(raw).decode(), turn, to, revisit, date)
                out.write(gzip.compress(text, 6, mtime=0))
                n += 1
                if out.tell() >= roll_bytes:
                    yield roll()
        if n:
            yield roll()

    placed = rows.unionByName(told).repartition(sum(spread), "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "url", "html")
    placed.mapInArrow(w.tidy(write), MANIFEST).write.parquet(f"{folder}/manifest")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a file."""
    view, at = memoryview(content), 0
    while at < len(content):
        stream, parts = zlib.decompressobj(31), []
        while not stream.eof:  # in small steps: what follows the record is not copied
            if at >= len(content):
                raise ValueError("the last record is cut short")
            parts.append(stream.decompress(view[at : at + 16384]))
            at += len(view[at : at + 16384])
        text, at = b"".join(parts), at - len(stream.unused_data)
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files in the manifest of ``folder``.

    Returns ``page_id``, ``url``, ``payload_bytes``, ``payload_digest`` (base32 SHA-1),
    ``record_type`` (response or revisit), ``refers_to`` (page_id of the response, for
    revisits) and ``html`` (null for revisits).  Files that do not match the manifest and
    payloads that do not match their digest are errors.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{folder}/data").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    listed = manifest.select("file", "n_records", "sha256").join(files, "file", "left").select("file", "n_records", "sha256", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(3)[i].as_py()
                if content is None or hashlib.sha256(content).hexdigest() != batch.column(2)[i].as_py():
                    raise ValueError(f"{batch.column(0)[i].as_py()} is not the file of the manifest")
                rows = []
                for headers, block in parse_records(content):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(head.rsplit(b"Content-Length: ", 1)[1])
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if headers["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}" or kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
                        raise ValueError(f"record {headers['WARC-Record-ID']} does not match its digest")
                    number = lambda name: int(headers[name]) if name in headers else None
                    url = headers.get("WARC-Target-URI")
                    rows.append((number("X-Page-ID"), url if url is None else _unheader(url), size, digest, kind, number("X-Refers-To-Page-ID"),
                                 payload.decode() if kind == "response" else None))
                if len(rows) != batch.column(1)[i].as_py():
                    raise ValueError(f"{batch.column(0)[i].as_py()} has {len(rows)} records")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))],
                    ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return listed.mapInArrow(parse, schema)
