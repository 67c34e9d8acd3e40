"""WARC/1.1 archives with an index: written record by record, read back by coalesced byte ranges.

Each task writes one archive to the shared folder and returns an index row per record: file, offset, length, url and
digest. A file's name holds the attempt, and only rows of successful attempts are kept, so a lost or repeated
task leaves at most a file that no index names. Readers sort the index rows they want by file and offset,
coalesce neighbours into one byte-range read, and parse the records out of it.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corpusmill.llm.shared import need, new_path, written

_URN = "urn:corpusmill:page:"
_INDEX = "file string, offset long, length long, url string, digest string, record_type string"
_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A response record, or a revisit of refers_to, whose block has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    line = lambda s: re.sub(r"[\r\n]", " ", s)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {line(url)}"] if url is not None else []
    head += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple:
    """The fields of _RECORDS of one record; a payload that does not have its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.decode().lower(): v.decode() for k, v in _HEAD.findall(head.partition(b"\r\n")[2] + b"\r\n")}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1])
    urn = lambda s: None if s is None or not (x := s[len(_URN) + 1 : -1]) else int(x)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    response = fields["warc-type"] == "response"
    if response and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    return urn(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], urn(fields.get("warc-refers-to")), payload if response else None


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, payload, sha) with refers_to: of payloads that are equal and have min_bytes at least, the
    largest page_id's is kept and the others refer to it. Equality is that of SHA-1."""
    large = pages.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    keepers = written(large.filter("n > 1 and keeper is not null").select(F.col("sha").alias("k_sha"), "keeper"), "warc-keepers")
    refers = F.when((F.octet_length("payload") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return pages.join(keepers, F.col("sha") == F.col("k_sha"), "left").withColumn("refers_to", refers).drop("k_sha", "keeper")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row below path, and return the index, itself a written table.

    Null html is an empty payload; a null url is left out of its record. Rows that share the largest id of their
    payload are all responses. A null id is written as none; where all ids of a payload are null, all are
    responses. No rows: an empty index. Other columns are not read.
    """
    need(pages, id_col, url_col, html_col)
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha"))

    def write(batches):
        context = TaskContext.get()
        name, out, at = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc", None, 0
        for batch in batches:
            if out is None:
                fs, root = _fs(path)
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}")
            index = []
            for page_id, url, data, sha, refers in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                made = record(page_id, url, data, digest, refers, date)
                out.write(made)
                index.append((f"{path}/{name}", at, len(made), url, digest, "response" if refers is None else "revisit"))
                at += len(made)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*index, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")]).cast(pa.schema([(n, pa.int64() if n in ("offset", "length") else pa.string()) for n in (x.split()[0] for x in _INDEX.split(", "))]))
        if out is not None:
            out.close()

    return written(revisits(rows, min_bytes).select("page_id", "url", "payload", "sha", "refers_to").mapInArrow(write, _INDEX), "warc-index")


def read_records(index: DataFrame, with_payload: bool = True, stripe: int = 8 << 20, max_gap: int = 64 << 10) -> DataFrame:
    """The records that index names, whose rows may be any selection of an index: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and payload (null for revisits, or without with_payload).

    There are as many tasks as the wanted records fill stripes, and rows of one stripe of a file go to one of them; there, records that
    lie at most max_gap bytes apart are read at once, up to a stripe's length (a longer record is read alone). Repeated index rows give
    repeated records; a row whose file, offset or length is null is an error; no rows give no records; other columns are not read."""

    def read(batches):
        held: list[tuple] = []

        def fetch():
            fs, name = _fs(held[0][0])
            begin = held[0][1]
            with fs.open_input_file(name) as f:
                data = f.read_at(max(a + n for _, a, n in held) - begin, begin)
            found = [parse(data[a - begin : a - begin + n]) for _, a, n in held]
            held.clear()
            columns = list(zip(*found, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            if not with_payload:
                columns[6] = (None,) * len(found)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _RECORDS.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (row[0] != held[0][0] or row[1] > held[-1][1] + held[-1][2] + max_gap or row[1] + row[2] - held[0][1] > stripe):
                    yield fetch()
                held.append(row)
        if held:
            yield fetch()

    wanted = index.select("file", "offset", "length")
    tasks = max(1, -(-(wanted.agg(F.sum("length")).first()[0] or 0) // stripe))
    wanted = wanted.repartition(tasks, "file", (F.col("offset") / stripe).cast("long"))
    return wanted.sortWithinPartitions("file", "offset").mapInArrow(read, _RECORDS)


def archive_path(spark) -> str:
    return new_path(spark, "warc")
