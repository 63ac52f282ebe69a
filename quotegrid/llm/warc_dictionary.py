"""Dictionary-compressed web archives.

Each task writes its records to archives of bounded size.  An archive's Zstandard dictionary is built from its own
first records (at most ``SAMPLE`` bytes), stands in a leading skippable frame, and every record is a frame of its own
compressed with it, so a record can be read alone from its offset.  The driver only plans: archives are written and
read by tasks, and the list of archives is itself a table in the shared folder, so what a lost task left half written
is never read.

Equal payloads are told by SHA-256.  The group's record with the largest ``page_id`` is a response, the others are
revisits that refer to it and carry no payload.

Defined results: null html is an empty payload.  Rows with null ``page_id`` are archived but never referred to while
another row has an id; rows that repeat page and payload: one is the response, the rest revisit it (by page id).
Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quotegrid.llm.arrays import rows_by
from quotegrid.session import settle, shared_folder

# The frame that holds the dictionary, and the revisit profile.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE, DICTIONARY, ARCHIVE = 2 << 20, 64 << 10, 256 << 20
SALTS = 32
EXTRA = "WARC-X-Payload-Length"


def file_system(uri: str):
    """Works for any store Arrow can open; the shared folder is named by URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def digest_name(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, copy: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{copy}')}>"


def one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record; revisits have the HTTP head but no payload."""
    payload = (row["html"] or "").encode()
    revisit = row["response_page"] is not None or row["revisit"]
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(row["page_id"], row["copy"])), ("WARC-Date", date),
              ("WARC-Target-URI", one_line(row["url"])), ("WARC-Payload-Digest", f"sha1:{digest_name(payload)}"), ("WARC-X-Page-Id", "" if row["page_id"] is None else str(row["page_id"])), (EXTRA, str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(row["response_page"], "")), ("WARC-X-Refers-To-Page", "" if row["response_page"] is None else str(row["response_page"]))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    fields = dict(x.partition(": ")[::2] for x in lines[1:])
    return fields, rest[:int(fields["Content-Length"])]


class Archive:
    """Records of one task; the first ``SAMPLE`` bytes wait until the dictionary is built."""

    def __init__(self, folder: str, name: str):
        self.path, self.waiting, self.held, self.stream, self.index = f"{folder}/{name}", [], 0, None, []

    def add(self, key, data: bytes) -> None:
        if self.stream is None:
            self.waiting.append((key, data))
            self.held += len(data)
            if self.held >= SAMPLE:
                self.start()
        else:
            self.put(key, data)

    def start(self) -> None:
        import zstandard as z

        samples = [d for _, d in self.waiting]
        try:
            trained = z.train_dictionary(min(DICTIONARY, max(1024, self.held // 8)), samples).as_bytes()
        except z.ZstdError:  # too few records to learn from: their bytes are the dictionary
            trained = b"".join(samples)[:DICTIONARY]
        files, path = file_system(self.path)
        self.stream = files.open_output_stream(path)
        self.stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained)
        self.at = 8 + len(trained)
        self.compressor = z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(trained), write_checksum=True)
        for key, data in self.waiting:
            self.put(key, data)
        self.waiting = []

    def put(self, key, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.stream.write(frame)
        self.index.append((key, self.at, len(frame)))
        self.at += len(frame)

    def close(self) -> None:
        if self.stream is None and self.waiting:
            self.start()
        if self.stream is not None:
            self.stream.close()


INDEX = "archive string, page_id long, frame_offset long, frame_length long"


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row of (page_id, url, html, revisit, response_page) and return the index, one row per record."""
    def write(batches):
        archive, n = None, 0

        def finished():
            archive.close()
            key, at, length = zip(*archive.index)
            return pa.RecordBatch.from_arrays([pa.array([archive.path] * len(key)), pa.array(key, pa.int64()), pa.array(at, pa.int64()), pa.array(length, pa.int64())], names=["archive", "page_id", "frame_offset", "frame_length"])

        for batch in rows_by(batches):
            for row in batch.to_pylist():
                n += 1
                archive = archive or Archive(folder, f"{uuid.uuid4().hex}.warc.zst")
                archive.add(row["page_id"], record(row | {"copy": str(n) if row["revisit"] else ""}, date))
                if archive.stream is not None and archive.at >= ARCHIVE:
                    yield finished()
                    archive = None
        if archive:
            yield finished()

    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    return settle(pages.select("page_id", "url", "html", "revisit", "response_page").mapInArrow(write, INDEX), "warc-index")


RECORDS = "archive string, page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Stream the records of the archives named in column ``archive``; a response's payload must match its digest."""
    def read(batches):
        import zstandard as z

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                files, path = file_system(name)
                with files.open_input_stream(path) as stream:
                    magic, length = struct.unpack("<II", stream.read(8))
                    if magic != DICTIONARY_MAGIC:
                        raise ValueError(f"{name} does not begin with a dictionary frame")
                    decompressor = z.ZstdDecompressor(dict_data=z.ZstdCompressionDict(stream.read(length)))
                    data, rows, size = b"", [], 0
                    while True:
                        frame = decompressor.decompressobj()
                        parts, data = [], data or stream.read(1 << 20)
                        if not data:
                            break
                        while not frame.eof:
                            parts.append(frame.decompress(data))
                            data = frame.unused_data if frame.eof else stream.read(1 << 20)
                            if not data and not frame.eof:
                                raise ValueError(f"{name} ends inside a record")
                        fields, block = parse(b"".join(parts))
                        revisit = fields["WARC-Type"] == "revisit"
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        if not revisit and (digest_name(payload) != digest or len(payload) != int(fields[EXTRA])):
                            raise ValueError(f"{name}: a payload does not match its digest")
                        number = lambda key: int(fields[key]) if fields.get(key) else None
                        rows.append((name, number("WARC-X-Page-Id"), fields["WARC-Type"], fields["WARC-Target-URI"], digest, int(fields[EXTRA]), number("WARC-X-Refers-To-Page"), payload if payloads else None))
                        size += len(payload or b"") if payloads else 0
                        if len(rows) >= 4096 or size >= 16 << 20:
                            yield records(rows)
                            rows, size = [], 0
                    if rows:
                        yield records(rows)

    def records(rows):
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in RECORDS.split(", ")])

    return archives.select("archive").mapInArrow(read, RECORDS)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """Adds ``revisit`` and ``response_page``.  Only groups of two and more are joined back, spread over
    ``SALTS`` keys each, so that a payload on a third of all pages is not one task's."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("payload"), F.monotonically_increasing_id().alias("row"))
    # among equal ids the largest row number is the response
    largest = F.max(F.struct("page_id", "row"))
    groups = (rows.groupBy("payload", F.pmod("row", F.lit(SALTS)).alias("part")).agg(largest.alias("top"), F.count("*").alias("n"))
              .groupBy("payload").agg(F.max("top").alias("top"), F.sum("n").alias("n")).where("n > 1")
              .select("payload", F.col("top.page_id").alias("top_page"), F.col("top.row").alias("top_row"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    joined = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(groups, ["payload", "salt"], "left")
    revisit = F.col("top_row").isNotNull() & (F.col("row") != F.col("top_row"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("top_page")).alias("response_page"))


def archives_of(index: DataFrame) -> DataFrame:
    """The archives of an index, over as many tasks: adaptive execution would merge their few bytes into one."""
    archives = index.select("archive").distinct()
    return archives.repartition(max(1, archives.count()))  # by the key it would be left out where distinct() has as many partitions


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(mark_revisits(pages), folder)
    return read_archives(archives_of(index), payloads=False)


def op2_query(spark, sf_dir: str) -> DataFrame:
    out = archive_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 in base32: five hex digits give four characters.
OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, body, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31), 1)
                        for k in range(32)], '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM h
"""
