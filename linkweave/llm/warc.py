"""WARC archives with an embedded Zstandard dictionary.

Every task writes archives of about ``ARCHIVE_BYTES`` of records into a folder that all
executors share. For each archive a dictionary is built from records spread over it,
stored in a leading skippable frame, and every record becomes a frame of its own
compressed with it. Of pages with equal payloads of at least ``LEAST`` bytes the one with
the smallest id is stored whole; the others become revisit records without a payload.

Scale: payload digests are grouped with a map-side combine, so a payload that a third of
all pages share is no hot group; only digests that occur more than once are joined back,
broadcast while they are few and by a shuffle otherwise. An archive is complete under a
temporary name before it is renamed, and a task that runs again writes the same names.
Reading takes a whole archive, of bounded size, at a time.

Nulls, ties: a null payload is empty; a null url is left out; a null id takes no part in
choosing and is a response unless a page with an id has its payload; rows repeated with
the same id and payload are all responses. Control characters in a url are escaped. An
empty table makes no archive. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.llm import common
from linkweave.session import shared_folder

ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
#: Records used to build an archive's dictionary hold about this many bytes.
SAMPLE_BYTES = 1 << 20
LEAST = 100
LEVEL = 3
FEW = 200_000
# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:linkweave:page:"

_MANIFEST = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def resolve(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is set for revisits."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    again = common.stash(
        rows.where(F.octet_length("payload") >= LEAST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "payloads",
    )
    side = F.broadcast(again) if again.count() <= FEW else again
    return rows.join(side, "digest", "left").select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        safe = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive: dictionary frame, then one frame per record."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:  # too few records to train on: they serve as they are
        dictionary = zstandard.ZstdCompressionDict(
            b"".join(sample)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    body = dictionary.as_bytes()
    return b"".join(
        [struct.pack("<II", SKIPPABLE, len(body)), body, *[press.compress(r) for r in records]]
    )


def write(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives; returns their manifest ``archive, records, bytes``."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made, held, size
            data = archive(held)
            name = f"part-{part:06d}-{made:05d}.warc.zst"
            draft = f"{base}/_{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(data)
            store.move(draft, f"{base}/{name}")
            row = {"archive": [name], "records": [len(held)], "bytes": [len(data)]}
            made, held, size = made + 1, [], 0
            return common.tables(row, _MANIFEST)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for k in range(batch.num_rows):
                held.append(record(*[c[k].as_py() for c in columns], date))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    manifest = resolve(pages).mapInArrow(run, "archive string, records long, bytes long")
    return common.stash(manifest, "manifest")


def records(content: bytes) -> list[tuple]:
    """The records of an archive, as the columns of ``read``."""
    import zstandard

    magic, length = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary")
    dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + length])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(
        io.BytesIO(memoryview(content)[8 + length :]), read_across_frames=True
    )
    data, at, out = reader.readall(), 0, []
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        head = dict(
            line.split(": ", 1) for line in data[at:stop].decode().split("\r\n")[1:]
        )
        begin = stop + 4
        end = begin + int(head["Content-Length"])
        payload = data[data.index(b"\r\n\r\n", begin) + 4 : end]
        at = end + 4
        number = head["WARC-Record-ID"][1 + len(URN) : -1]
        kind = head["WARC-Type"]
        refers = head.get("WARC-Refers-To")
        out.append(
            (
                int(number) if number else None,
                head.get("WARC-Target-URI"),
                len(payload) if kind == "response" else int(head["WARC-Payload-Length"]),
                hashlib.sha256(payload).hexdigest()
                if kind == "response"
                else head["WARC-Payload-Digest"].split(":")[1],
                kind,
                int(refers[1 + len(URN) : -1]) if refers else None,
                payload if kind == "response" else None,
            )
        )
    return out


def read(folder_files: DataFrame) -> DataFrame:
    """The records of archives given as ``content`` rows (Spark's binaryFile source)."""

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = records(content.as_py())
                for first in range(0, len(found), 1000):
                    columns = zip(*found[first : first + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, _RECORD, strict=True)],
                        schema=_RECORD,
                    )

    return folder_files.select("content").mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, payload binary",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages`` and reads the archives back."""
    spark = pages.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/linkweave-warc-{uuid.uuid4().hex}"
    manifest = write(pages, folder)
    if not manifest.take(1):
        return spark.createDataFrame(
            [],
            "page_id long, url string, payload_bytes long, payload_digest string, "
            "record_type string, refers_to long, payload binary",
        )
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return read(files)
