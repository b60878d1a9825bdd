"""WARC archives of individually compressed records with a dictionary in a leading skippable frame."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.worker import bounded_batches, state, tidy
from quarry.storage import shared_dir

#: Fixed values of the format: the skippable frame that carries a dictionary, and the revisit profile.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, kind: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One uncompressed record. A revisit has no body; what it stands for is in its header."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url or 'urn:none')}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    body = payload
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
        body = b""
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields by lower-case name, with the body under "body". Raises ValueError on a broken record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length doesn't match its header")
    return fields | {"body": rest[:size]}


class ArchiveWriter:
    """Frames of one archive: the dictionary first, then a frame for each record."""

    def __init__(self, dictionary: bytes, level: int):
        import zstandard as z

        self.prefix = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary if dictionary else b""
        more = {"dict_data": z.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compress = z.ZstdCompressor(level=level, write_content_size=True, write_checksum=True, **more).compress


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of one archive, by the dictionary that it carries."""
    import zstandard as z

    more = {}
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_FRAME:
        size = struct.unpack_from("<I", content, 4)[0]
        more = {"dict_data": z.ZstdCompressionDict(content[8 : 8 + size])}
        content = content[8 + size :]
    decompressor = z.ZstdDecompressor(**more)
    view, at = memoryview(content), 0
    while at < len(view):
        one, parts = decompressor.decompressobj(), []
        while not one.eof and at < len(view):  # fed in steps, since what is left of the last one is copied
            step = view[at : at + (1 << 14)]
            parts.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield b"".join(parts)


def train_dictionary(pages: DataFrame, html_col: str, sample_rows: int = 400, row_bytes: int = 20_000, size: int = 1 << 16) -> bytes:
    """A dictionary made from at most ``sample_rows`` records of whole payloads, each of at most ``row_bytes`` bytes; empty if they are too few to train on."""
    import zstandard as z

    rows = pages.select(F.col(html_col).cast("string").cast("binary").alias("body")).filter(F.length("body").between(1, row_bytes)).take(sample_rows)
    samples = sorted(record(k, None, "response", bytes(r.body), hashlib.sha1(bytes(r.body)).hexdigest(), None) for k, r in enumerate(rows))
    try:
        return z.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except z.ZstdError:
        return b""


def assign_records(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``pages`` with payload binary, payload_bytes, payload_digest, record_type and refers_to.

    Of equal payloads of at least ``min_bytes`` the one with the largest id is the response. That id is
    found by a pre-aggregated maximum for each digest, so a payload that a third of all pages share is
    no hot group; the join back is one that Spark can split.
    """
    base = pages.withColumn("payload", F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b"")))
    base = base.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload")).withColumn("_same", F.sha2("payload", 256))
    heads = (
        base.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("_same").alias("_head"), F.col("payload_bytes").alias("_size"))
        .agg(F.max(id_col).alias("_response"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    out = base.join(heads, (F.col("_same") == F.col("_head")) & (F.col("payload_bytes") == F.col("_size")), "left")
    other = F.col("_response").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_response"))
    return out.withColumn("record_type", F.when(other, "revisit").otherwise("response")).withColumn("refers_to", F.when(other, F.col("_response"))).drop("_same", "_head", "_size", "_response")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000, archive_bytes: int = 8 << 20, level: int = 6) -> None:
    """Write a record for every page into archives of about ``archive_bytes`` of payload under ``path``.

    ``path`` is a Parquet table with one row for each archive: name, n_records, content binary. A
    content is a whole .warc.zst file: the dictionary in a skippable frame, then a frame for each record, so
    any record can be read by itself. The table makes the write atomic for each task, on any store that
    Spark can write to; ``export_archives`` copies contents to files.

    A null html is an empty payload, a null url becomes urn:none; ids should be unique: of rows that
    repeat the id of a response, each is a response. An empty table gives no archive. Columns other than those named
    are ignored.
    """
    bounded_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast((train_dictionary(pages, html_col), level))
    key = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = state(key, lambda: ArchiveWriter(*shared.value))
        frames, size = [], 0

        def archive() -> pa.RecordBatch:
            content = writer.prefix + b"".join(frames)
            name = hashlib.sha1(content).hexdigest() + ".warc.zst"
            return pa.RecordBatch.from_pydict({"name": [name], "n_records": pa.array([len(frames)], pa.int64()), "content": pa.array([content], pa.binary())})

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, kind, refers_to = (c[k].as_py() for c in batch.columns)
                frames.append(writer.compress(record(page_id, url, kind, payload, digest, refers_to)))
                size += len(payload)
                if size >= archive_bytes:
                    yield archive()
                    frames, size = [], 0
        if frames:
            yield archive()

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), (F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")).alias("url"), F.col(html_col).alias("html"))
    rows = assign_records(plain, "page_id", "html", min_bytes).select("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    rows.mapInArrow(tidy(write, key), "name string, n_records long, content binary").write.parquet(path)


def read_warc(archives: DataFrame) -> DataFrame:
    """Every record of a table of archives: page_id, url, record_type, payload_digest, payload_bytes, refers_to, body.

    The body of a response is held against its digest and length; a mismatch fails the task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda field: None if field in (None, "<urn:page:null>") else int(field[len("<urn:page:") : -1])
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "body"]

        def table(rows: list) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows = []
                for data in read_archive(content.as_py()):
                    f = parse_record(data)
                    digest = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and (hashlib.sha1(f["body"]).hexdigest() != digest or len(f["body"]) != int(f["x-payload-length"])):
                        raise ValueError(f"record {f['warc-record-id']} doesn't match its digest")
                    rows.append((number(f["warc-record-id"]), f["warc-target-uri"], f["warc-type"], digest, int(f["x-payload-length"]), number(f.get("warc-refers-to")), f["body"]))
                    if len(rows) >= 500:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    return archives.select("content").mapInArrow(tidy(read), "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, body binary")


def export_archives(archives: DataFrame, folder: str) -> int:
    """Copy archives, one at a time, into files of a folder on this machine; their number."""
    n = 0
    for row in archives.select("name", "content").toLocalIterator():
        with open(f"{folder}/{row.name}", "wb") as f:
            f.write(row.content)
        n += 1
    return n


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and give back the records that are read from there."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, **options)
    return read_warc(pages.sparkSession.read.parquet(path))
