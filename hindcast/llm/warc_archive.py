"""WARC archives of individually compressed records with an embedded dictionary (operator 8).

Each task writes one archive below the shared folder. It trains a Zstandard dictionary on its first records
(``TRAIN_BYTES`` at most, spread evenly over them), writes the dictionary as a leading skippable frame, and then
every record as a frame of its own, so a reader can start at any record. Payloads seen elsewhere become revisit
records that refer to the response with the smallest page_id and carry no payload.

The result is read back from the archives: digest and size of a response are computed from its payload; a
revisit takes both from the response that it refers to, and its stored digest must agree.

An archive is written under a name of its attempt and renamed when complete; the list of archives comes
from the tasks that succeeded, so what a lost executor left behind is never read.

Edge cases: a null html is an empty payload, and empty payloads revisit each other like any others; of repeated rows
with the smallest page_id of a payload each is a response; a null page_id comes after all others; very long payloads are one record each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import bounded_batches, materialize, table
from hindcast.llm.registry import query
from hindcast.session import shared_dir

#: fixed values of the formats: frame magics, least payload that may be a revisit, revisit profile
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT_BYTES = 0
TRAIN_BYTES, DICTIONARY_BYTES = 4 << 20, 64 << 10
LEVEL = 6
READ_BYTES = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id, digest: str) -> str:
    name = f"{'' if page_id is None else page_id}/{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(kind: str, page_id, urn: str, url: str | None, payload: bytes | None, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload or b'')}\r\n\r\n"
    block = http.encode() + payload if payload is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", urn),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "urn:none").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Source-Page", "" if page_id is None else str(page_id)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def train_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records, or None where there are too few to learn from."""
    if len(samples) < 8:
        return None
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL, threads=0)
    except zstandard.ZstdError:
        return None


def write_archive(out, records: Iterator[bytes], train_bytes: int = TRAIN_BYTES) -> tuple[int, int]:
    """Dictionary frame and record frames to a binary stream: number of records, bytes written."""
    held, size, written = [], 0, 0
    for data in records:
        held.append(data)
        size += len(data)
        if size >= train_bytes:
            break
    learned = train_dictionary([x[: 128 << 10] for x in held])
    if learned is not None:
        content = zstandard.ZstdCompressor(level=19).compress(learned.as_bytes())
        out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        written += 8 + len(content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_checksum=True, write_content_size=True)
    n = 0

    def put(data: bytes) -> None:
        nonlocal n, written
        frame = compressor.compress(data)
        out.write(frame)
        n += 1
        written += len(frame)

    for data in held:
        put(data)
    held.clear()
    for data in records:
        put(data)
    return n, written


def read_archive(source) -> Iterator[bytes]:
    """Records of an archive, one frame after the other, from a binary stream."""
    head = source.read(8)
    learned = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        content = source.read(struct.unpack("<I", head[4:])[0])
        if content.startswith(FRAME):
            content = zstandard.ZstdDecompressor().decompress(content)
        learned, head = zstandard.ZstdCompressionDict(content), b""
    opened = zstandard.ZstdDecompressor(dict_data=learned) if learned else zstandard.ZstdDecompressor()
    rest = head
    frame, parts, inside = opened.decompressobj(), [], False
    while True:
        if not rest:
            rest = source.read(READ_BYTES)
            if not rest:
                break
        parts.append(frame.decompress(rest))
        inside = not frame.eof
        if frame.eof:
            yield b"".join(parts)
            rest = frame.unused_data
            frame, parts = opened.decompressobj(), []
        else:
            rest = b""
    if inside:
        raise ValueError("an archive is cut short")


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder and the path on it, in any task."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html and the smallest page_id with the same payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("least"))
    return rows.join(first, "digest")


def write_pages(pages: DataFrame, folder: str, archives: int | None = None) -> DataFrame:
    """Write all pages as archives below ``folder`` and return (path, records, bytes) of each archive."""
    spark = pages.sparkSession
    bounded_batches(spark)
    planned = plan_records(pages).withColumn("heads", F.col("page_id").eqNullSafe(F.col("least")))
    if archives:
        planned = planned.repartition(archives, "page_id", "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page in batch.to_pylist():
                    payload = page["html"].encode("utf-8", "surrogatepass")
                    digest = base32_sha1(payload)
                    if page["heads"] or len(payload) < LEAST_REVISIT_BYTES:
                        yield record("response", page["page_id"], record_urn(page["page_id"], digest), page["url"], payload, digest, None)
                    else:
                        target = record_urn(page["least"], digest)
                        yield record("revisit", page["page_id"], f"<urn:uuid:{uuid.uuid4()}>", page["url"], None, digest, target)

        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/pages-{uuid.uuid4().hex}.warc.zst"
        with system.open_output_stream(f"{name}.part", compression=None) as out:
            n, size = write_archive(out, records())
        if n:
            system.move(f"{name}.part", name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})
        else:
            system.delete_file(f"{name}.part")

    return materialize(planned.mapInArrow(write, "path string, records long, bytes long"))


def read_pages(archives: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives: page_id, record_type, urn, refers_to_urn, payload_bytes, payload_digest, stored_digest."""
    schema = "page_id long, record_type string, urn string, refers_to_urn string, payload_bytes long, payload_digest string, stored_digest string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "urn", "refers_to_urn", "payload_bytes", "payload_digest", "stored_digest"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        system, _ = open_folder(folder)
        for batch in batches:
            for path in batch["path"].to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as source:
                    for data in read_archive(source):
                        fields, payload = parse_record(data)
                        page_id = fields["WARC-Source-Page"]
                        full = fields["WARC-Type"] == "response"
                        rows.append(
                            (
                                int(page_id) if page_id else None,
                                fields["WARC-Type"],
                                fields["WARC-Record-ID"],
                                fields.get("WARC-Refers-To"),
                                len(payload) if full else None,
                                base32_sha1(payload) if full else None,
                                fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                            )
                        )
                        if len(rows) == 5000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    n = archives.count()
    return archives.repartition(max(1, n), "path").mapInArrow(read, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write, read back, and describe every page's record."""
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    found = materialize(read_pages(write_pages(pages, folder), folder))
    responses = found.filter("record_type = 'response'").select(
        F.col("urn").alias("refers_to_urn"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("payload_digest").alias("full_digest")
    ).dropDuplicates(["refers_to_urn"])
    # only revisits look for another record; responses have all of their own
    own = found.filter("refers_to_urn is null")
    joined = found.filter("refers_to_urn is not null").join(responses, "refers_to_urn", "left").unionByName(own, allowMissingColumns=True)
    digest = F.coalesce("payload_digest", "full_digest")
    checked = F.when(digest == F.col("stored_digest"), digest).otherwise(
        F.raise_error(F.concat(F.lit("stored and read digests differ for page "), F.coalesce(F.col("page_id").cast("string"), F.lit("?"))))
    )
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to"
    )


CHECK = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hashed AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS least FROM sized),
bits AS (SELECT *, array_to_string([lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0') for c in string_split(hex, '')], '') AS b FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
      16 * CAST(substr(b, 5 * k + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * k + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * k + 3, 1) AS INTEGER)
      + 2 * CAST(substr(b, 5 * k + 4, 1) AS INTEGER) + CAST(substr(b, 5 * k + 5, 1) AS INTEGER) AS BIGINT), 1) for k in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to
FROM bits
"""


@query("op8_warc_archives", CHECK)
def op8_warc_archives(spark, sf_dir):
    return archived_pages(table(spark, sf_dir, "pages"))
