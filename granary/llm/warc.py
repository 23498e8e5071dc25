"""WARC archives in which repeated payloads are revisit records."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import new_path, parts, table, unused

#: Smaller payloads are always written whole.
LEAST_REVISIT_BYTES = 1000
#: An archive file takes records until it holds so many bytes before compression, and the last of them is whole.
FILE_BYTES = 48 << 20
#: A member of a gzip file holds at most so many bytes: then the last byte of its length field is zero.
MEMBER_BYTES = (1 << 24) - 1
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_URN = "urn:x-page:"


def resolve_revisits(pages: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """pages with payload (html, null: empty), payload_bytes, payload_digest, record_type and refers_to.

    Only digests and ids are shuffled to find repeated payloads, and they are combined before the shuffle, so one very
    common payload is a row for each task; digests that occur once go no further. The join back is an equi-join with a
    table of the repeated digests alone, which Spark broadcasts when it measures it as small and whose hot digests it
    splits otherwise. Of equal payloads of at least least_bytes the row with the largest page_id is the response (rows
    that share that id all are); null ids come last. Columns of pages with a name of the five give way.
    """
    digest, response, n = (unused(x, pages.columns) for x in ("_digest", "_response", "_n"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    headed = pages.withColumn("payload", html).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.encode("payload", "UTF-8")))
    repeated = (
        headed.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias(digest))
        .agg(F.max("page_id").alias(response), F.count("*").alias(n)).where(F.col(n) > 1).drop(n)
    )
    joined = headed.join(repeated, (headed.payload_digest == F.col(digest)) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col(response).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(response))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col(response))).drop(digest, response)


def _pack(file_bytes: int):
    """Gzip members of records, without their last byte, and which of the task's files each goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written = 0
        for batch in parts(batches, 500):
            files, members = [], []
            for record in batch.column(0):
                content = record.as_buffer()
                for lo in range(0, content.size, MEMBER_BYTES):
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(memoryview(content)[lo : lo + MEMBER_BYTES]) + packer.flush()
                    files.append(written // file_bytes)
                    members.append(member[:-1])
                written += content.size
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(members, pa.binary())], ["file", "value"])

    return run


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """A WARC/1.1 record for every row of pages (page_id, url, html), resolved by resolve_revisits(), in gzip files under path.

    Every record is a gzip member of its own, so it can be read alone (one of more than MEMBER_BYTES is several). Spark's
    text writer and commit protocol write them, so a task that is run again leaves no half file: a member's last byte
    is zero, and it is written as the line separator. Files are bounded by bytes, whatever the sizes of pages. Revisit
    records have the HTTP header of their response, with the length of the full payload, and no payload.
    """
    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    uri = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit(f"<{PAGE_URN}"), page, F.lit(">"))), line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(F.col("record_type") == "revisit", F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit(f"<{PAGE_URN}"), F.col("refers_to").cast("string"), F.lit(">"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"), block, F.lit("\r\n\r\n"),
    )
    records = resolve_revisits(pages.select("page_id", "url", "html")).select(F.encode(record, "UTF-8").alias("record"))
    packed = records.mapInArrow(_pack(file_bytes), "file long, value binary").select("file", F.col("value").cast("string"))
    packed.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(path)


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def members(content: memoryview, step: int = 1 << 15) -> Iterator[bytes]:
    """What each member of a gzip file holds, one after the other."""
    at = 0
    while at < len(content):
        reader, found = zlib.decompressobj(31), []
        while not reader.eof:
            if at >= len(content):
                raise ValueError("the last member is cut off")
            found.append(reader.decompress(content[at : at + step]))
            at = min(at + step, len(content)) - len(reader.unused_data)
        yield b"".join(found)


def parse_records(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of every record of an archive, by the lengths that the headers state."""
    held = b""
    for member in members(content):
        held = held + member if held else member
        end = held.index(b"\r\n\r\n") + 4
        if not held.startswith(b"WARC/1.1\r\n"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.decode(): v.decode() for k, v in HEADER.findall(held[10:end])}
        n = int(fields["Content-Length"])
        if len(held) < end + n + 4:
            continue  # the record goes on in the next member
        if held[end + n :] != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it says")
        yield fields, held[end : end + n]
        held = b""
    if held:
        raise ValueError("the last record is cut off")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda x: int(x) if x.lstrip("-").isdigit() else None
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], READ_NAMES)
    for batch in batches:
        for packed in batch.column(0):
            rows, held = [], 0
            for fields, block in parse_records(memoryview(packed.as_buffer())):
                head, _, payload = block.partition(b"\r\n\r\n")
                http = {k.decode().lower(): v.decode() for k, v in HEADER.findall(head.split(b"\r\n", 1)[1] + b"\r\n")}
                page, to = fields["WARC-Record-ID"], fields.get("WARC-Refers-To", "")
                urn = len(PAGE_URN) + 1
                rows.append((number(page[urn:-1]), fields["WARC-Target-URI"], int(http["content-length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], number(to[urn:-1]), payload if fields["WARC-Type"] == "response" else None))
                held += len(block)
                if held > 4 << 20:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)


READ_NAMES = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for every record under path; payload is null for revisit records. A file is one task's work, see FILE_BYTES."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
with p as (
    select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
    select payload_digest, max(page_id) as response from p where payload_bytes >= {LEAST_REVISIT_BYTES} group by 1
)
select p.page_id, p.payload_bytes, p.payload_digest,
    case when g.response <> p.page_id then 'revisit' else 'response' end as record_type,
    case when g.response <> p.page_id then g.response end as refers_to
from p left join g on g.payload_digest = p.payload_digest and p.payload_bytes >= {LEAST_REVISIT_BYTES}
"""
