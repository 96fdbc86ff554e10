"""WARC archives: writing, normalising a monolithic gzip stream to one member per record, and reading by offset.

The writer makes archives of a bounded size, each one gzip stream over many records. The normaliser streams such an archive
once, in pieces, rewrites every record as a gzip member of its own and writes a sidecar beside the new archive that has the
offset and length of each. Reading goes by the sidecars. Nothing is held but the record at hand.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.session import save, scratch


#: Equal payloads below this many bytes are all kept.
LEAST_REVISIT = 1000
#: Uncompressed bytes after which an archive is closed (a record more, at most); an archive is one task's work.
ARCHIVE_BYTES = 64_000_000
#: Bytes that are inflated at a time.
PIECE = 1 << 20
ID = "urn:gridwright:page:"
SIDECAR = ".index.parquet"
MANIFEST = "file string, records long"
INDEX = "file string, offset long, length long, record_id string, record_type string"


def classified(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(id, url, payload, bytes, digest, leader): leader is the largest id among equal payloads of `least` bytes or more, else null.

    A null payload is empty, a null url is about:blank. A row without an id never leads, unless no other row has its
    payload; it then is a response. Rows with an id and a payload in common are all responses if that id leads. A page may be as
    long as a string can be (2 GB)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("about:blank")), r"[\x00-\x20]", "%20")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), payload.alias("payload")).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha1(F.col("payload").cast("binary"))})
    same = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return rows.join(save(same, "warc-leaders"), ["digest", "bytes"], "left")


def records(rows: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(record) text of each row of classified(), without the blank lines that end it."""
    eol = "\r\n"
    revisit = F.col("leader").isNotNull() & ~F.col("leader").eqNullSafe(F.col("id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{eol}Content-Type: text/html; charset=utf-8{eol}Content-Length: "), F.col("bytes"), F.lit(eol * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), F.col("digest"), F.lit(">"))
    head = [
        F.concat(F.lit(f"WARC/1.1{eol}WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{eol}WARC-Refers-To: "), name("leader"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return rows.select(F.concat(F.concat_ws(eol, *head), F.lit(eol * 2), block).alias("record"))


def write_archives(rows: DataFrame, path: str) -> DataFrame:
    """Monolithic archives under `path`, each one gzip stream of some ARCHIVE_BYTES of records; (file, records) of each. Names are
    new for each attempt of a task, so only the files of this table count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(path)
        attempt, made, out = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, size, n = f"pages-{attempt}-{len(made):04d}.gz", 0, 0
                    out, squeeze = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20), zlib.compressobj(6, zlib.DEFLATED, 31)
                record = text.as_py() + b"\r\n\r\n"
                out.write(squeeze.compress(record))
                size, n = size + len(record), n + 1
                if size >= ARCHIVE_BYTES:
                    out.write(squeeze.flush())
                    out.close()
                    made, out = [*made, (name, n)], None
        if out is not None:
            out.write(squeeze.flush())
            out.close()
            made.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["file", "records"])

    return save(records(rows).mapInArrow(run, MANIFEST), "warc-manifest")


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, whole record with the blank lines after it) of each record in a stream of bytes."""
    held, at = bytearray(), 0
    pieces = iter(pieces)

    def more() -> bool:
        nonlocal at
        piece = next(pieces, None)
        if piece is None:
            return False
        del held[:at]
        at = 0
        held.extend(piece)
        return True

    while True:
        while (stop := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if held[at:].strip():
                    raise ValueError("the archive ends within a header")
                return
        lines = held[at:stop].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = stop - at + 4 + int(fields["Content-Length"]) + 4
        while len(held) - at < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(held[at : at + size])
        at += size


def inflate(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of one or several gzip members, in pieces of bounded size, each byte inflated once."""
    stream = None
    for chunk in chunks:
        while chunk:
            stream = stream or zlib.decompressobj(wbits=31)
            if piece := stream.decompress(chunk, PIECE):
                yield piece
            chunk = stream.unconsumed_tail
            if stream.eof:
                chunk, stream = stream.unused_data, None
    while stream and not stream.eof:
        if not (piece := stream.decompress(b"", PIECE)):
            raise ValueError("the gzip stream is cut off")
        yield piece


def normalise(spark: SparkSession, archives: DataFrame, source: str, target: str) -> DataFrame:
    """The archives (file, ...) of `source` rewritten under `target`, each with a sidecar beside it; the table of all sidecars. Files
    appear under their names when they are whole and always hold the same, so a task that runs twice does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (old, there), (fs, base) = pa.fs.FileSystem.from_uri(source), pa.fs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for name in b.column(0).to_pylist():
                file, draft, offset, rows = name.removesuffix(".gz") + ".warc.gz", f"{base}/.{uuid.uuid4().hex}", 0, []
                with old.open_input_file(f"{there}/{name}") as whole, fs.open_output_stream(draft, compression=None, buffer_size=1 << 20) as out:
                    for fields, record in split_records(inflate(iter(lambda: whole.read(1 << 18), b""))):
                        member = gzip.compress(record, 6, mtime=0)
                        out.write(member)
                        rows.append((file, offset, len(member), fields["WARC-Record-ID"], fields["WARC-Type"]))
                        offset += len(member)
                columns = list(zip(*rows)) or [()] * 5
                sidecar = pa.table([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["file", "offset", "length", "record_id", "record_type"])
                pa.parquet.write_table(sidecar, f"{draft}.index", filesystem=fs)
                fs.move(f"{draft}.index", f"{base}/{file}{SIDECAR}")
                fs.move(draft, f"{base}/{file}")
            yield pa.RecordBatch.from_arrays([b.column(0)], ["file"])

    files = archives.count()
    if not files:
        return spark.createDataFrame([], INDEX)
    save(archives.select("file").repartition(files).mapInArrow(run, "file string"), "warc-normalised")
    return spark.read.schema(INDEX).option("pathGlobFilter", f"*{SIDECAR}").parquet(target)


def page_of(name: str) -> int | None:
    """The page id in a record's name."""
    number = name.strip("<>").removeprefix(ID).split(":")[0]
    return None if number == "none" else int(number)


def _read(member: bytes) -> tuple:
    fields, record = next(split_records(iter([gzip.decompress(member)])))
    digest, size, refers = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["WARC-Payload-Length"]), None
    if fields["WARC-Type"] == "revisit":
        refers = page_of(fields["WARC-Refers-To"])
    else:
        block = record.index(b"\r\n\r\n") + 4
        payload = record[record.index(b"\r\n\r\n", block) + 4 : -4]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return page_of(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers


def read_records(index: DataFrame, target: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from each indexed record. Length and digest of a
    response are measured on its payload, those of a revisit are in its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(target)
        for b in batches:
            rows = []
            entries = zip(*(b.column(i).to_pylist() for i in range(3)))
            for file, members in groupby(entries, key=lambda e: e[0]):
                with fs.open_input_file(f"{base}/{file}") as archive:
                    rows += [_read(archive.read_at(length, offset)) for _, offset, length in members]
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("file", "offset", "length").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, **columns) -> tuple[DataFrame, str]:
    """Index and folder of normalised archives of all pages. No pages: an empty index."""
    spark = pages.sparkSession
    source, target = scratch(spark, "warc-monolithic"), scratch(spark, "warc")
    return normalise(spark, write_archives(classified(pages, **columns), source), source, target), target


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what the archives of all pages hold, read back record by record."""
    return read_records(*archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


ORACLE = """SELECT page_id, CAST(octet_length(encode(p)) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest,
 CASE WHEN octet_length(encode(p)) >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN octet_length(encode(p)) >= 1000 AND page_id < last THEN last END AS refers_to
FROM (SELECT page_id, p, max(page_id) OVER (PARTITION BY p) AS last FROM (SELECT page_id, coalesce(html, '') AS p FROM pages))"""
