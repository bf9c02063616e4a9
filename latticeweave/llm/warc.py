"""Content-addressed WARC archive.

Kept in three tables and standard files below one folder:

* ``records``: a row per page: its id, url, digests, length, type and the exact header block of its WARC record;
* ``payloads``: each distinct payload once, keyed by its SHA-256 digest, which is computed again on every read. The
  table is bucketed by digest, so that rebuilding records moves headers and no payload;
* ``about``: the number of buckets;
* ``export_warc`` / ``import_warc``: gzipped WARC/1.1 files, rebuilt from the tables by a join, and read back as a stream.

A record id is ``<urn:page:ID:N>``, N being the row's number in ``records``, so ids are unique for null and repeated page
ids too. Characters that would end a header line (and %) are percent-encoded in ids and urls; ``records`` keeps the
original url.

Hot digests (an empty payload, or one that a third of all pages share) are salted in every join on the digest.

Defined cases: a null payload is empty; a null url has no target line, an empty one an empty target; rows with a null id
never win against one that has an id, and are responses where all ids of a payload are null; equal rows (same id and
payload) have the same type, so two equal winners are both responses, and the payload is still stored once; an empty
table gives empty archives. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bounded_batches, spread_join, work_dir, written

CRLF = "\r\n"
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT = 1000


def _line_safe(text: Column) -> Column:
    """One header line's worth: % and control characters as %XX."""
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(">"), F.lit("%3E"))


def _record_id(page: Column, number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), _line_safe(F.coalesce(page.cast("string"), F.lit(""))), F.lit(":"), number.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    """The exact header block of a row of ``records``, with the empty line that ends it."""
    revisit = F.col("kind") == "revisit"
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("kind")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("number"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _line_safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.lower(F.hex("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("winner.page_id"), F.col("winner.number")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2))


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write ``path/records``, ``path/payloads`` and ``path/about``.

    Types are decided on digests and ids alone. Payload bytes move once, after equal ones have met map-side, so a payload
    that a third of all rows share costs one row a task."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    # Numbered and written once: a row's number is then a fact, however often it is read.
    slim = written(rows.select("page_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n"), F.unhex(F.sha1("payload")).alias("sha1"), F.monotonically_increasing_id().alias("number")), f"{path}/digests")
    large = slim.where(F.col("n") >= min_revisit)
    winner = large.groupBy("sha256").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("named"), F.col("page_id").alias("page_id"), F.col("number").alias("number"))).alias("winner"))
    typed = spread_join(large, winner, "sha256", "inner").unionByName(slim.where(F.col("n") < min_revisit).withColumn("winner", F.lit(None).cast(winner.schema["winner"].dataType)))
    revisit = F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner.page_id"))
    typed = typed.withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
    typed.select("page_id", "url", "sha256", "kind", "number", _header(date).alias("header")).write.mode("overwrite").parquet(f"{path}/records")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"payloads_{uuid.uuid4().hex}"
    rows.select("sha256", "payload").dropDuplicates(["sha256"]).write.bucketBy(buckets, "sha256").sortBy("sha256").option("compression", "zstd").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are the archive's
    spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{path}/about")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, payload), each digest verified against the stored bytes; a mismatch fails the read."""
    buckets = spark.read.parquet(f"{path}/about").first().buckets
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (sha256 BINARY, payload BINARY) USING parquet CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{path}/payloads'")
    stored = spark.table(name)
    stored.schema  # noqa: B018 - resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    sound = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    return stored.select("sha256", F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a payload doesn't match its digest"))).alias("payload"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """Original records: (page_id, url, header, payload, record), where record holds the exact bytes of the WARC record
    and payload the full payload, for revisits that of the record they refer to. A missing payload fails the read."""
    joined = spread_join(spark.read.parquet(f"{path}/records"), read_payloads(spark, path), "sha256")
    payload = F.coalesce("payload", F.raise_error(F.lit("a record's payload is missing")).cast("binary"))
    block = F.when(F.col("kind") == "revisit", F.lit("").cast("binary")).otherwise(payload)
    return joined.select("page_id", "url", "header", payload.alias("payload"), F.concat(F.col("header").cast("binary"), block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def export_warc(spark: SparkSession, path: str, out: str, records_per_file: int = 20_000) -> None:
    """Standard .warc.gz files. Revisits carry no block, so only responses meet their payloads. The text writer's line
    separator is the two empty lines that end each WARC record."""
    records = spark.read.parquet(f"{path}/records")
    full = spread_join(records.where("kind = 'response'"), read_payloads(spark, path), "sha256")
    block = F.coalesce(F.col("payload").cast("string"), F.raise_error(F.lit("a record's payload is missing")))
    lines = full.select(F.concat("header", block).alias("value")).unionByName(records.where("kind = 'revisit'").select(F.col("header").alias("value")))
    lines.write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(out)


def parse_stream(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """(header, block) of each record of one file, whose bytes come in pieces; holds one record at a time."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while True:
            if held.startswith(b"\r\n"):  # only what the reader's own separator adds behind a file's last record
                del held[: len(held) - len(held.lstrip(b"\r\n"))]
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            size = re.search(rb"(?mi)^Content-Length: *(\d+)\r?$", held[: end + 2])
            if size is None:
                raise ValueError("a record without a length")
            end += 4
            stop = end + int(size[1])
            if len(held) < stop + 4:
                break
            if held[stop : stop + 4] != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            yield held[:end].decode(), bytes(held[end:stop])
            del held[: stop + 4]
    if held.strip(b"\r\n"):
        raise ValueError("a file ends inside a record")


def _files(batches, digest_only: bool):
    """Gzipped files are read whole by one task and in order, so their pieces make one stream for each path."""
    import pyarrow as pa

    def pieces():
        for batch in batches:
            for path, value in zip(batch.column("path").to_pylist(), batch.column("value"), strict=True):
                yield path, value.as_buffer().to_pybytes() + b"\r\n\r\n"

    def of_file(first, rest, ahead):
        path, piece = first
        yield piece
        for path_now, piece in rest:
            if path_now != path:
                ahead.append((path_now, piece))
                return
            yield piece

    def out(rows):
        names = ["header", "block_bytes", "block_sha1"] if digest_only else ["header", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names)

    stream, ahead = pieces(), []
    first = next(stream, None)
    while first is not None:
        rows, size = [], 0
        for header, block in parse_stream(of_file(first, stream, ahead)):
            rows.append((header, len(block), hashlib.sha1(block).hexdigest()) if digest_only else (header, block))
            size += len(header) + (0 if digest_only else len(block))
            if size > 8 << 20 or len(rows) >= 4096:
                yield out(rows)
                rows, size = [], 0
        if rows:
            yield out(rows)
        first = ahead.pop() if ahead else next(stream, None)


def import_warc(spark: SparkSession, out: str, digest_only: bool = False) -> DataFrame:
    """(header, payload) of every record in the files, or (header, block_bytes, block_sha1) of the bytes read."""
    bounded_batches(spark)
    lines = spark.read.option("lineSep", CRLF * 2).text(out).select(F.input_file_name().alias("path"), F.col("value").cast("binary").alias("value"))
    schema = "header string, block_bytes long, block_sha1 string" if digest_only else "header string, payload binary"
    return lines.mapInArrow(lambda batches: _files(batches, digest_only), schema)


def field(name: str) -> Column:
    """A header's value; names stand at the start of a line, so urls can't pass for them."""
    found = F.regexp_extract("header", rf"(?md)^{name}: (.*?)\r$", 1)
    return F.when(F.col("header").rlike(rf"(?md)^{name}: "), found)


def page_of(record_id: Column) -> Column:
    """The page id inside a record id, as text; null where it was null."""
    page = F.regexp_extract(record_id, r"^<urn:page:(.*):\d+>$", 1)
    plain = F.replace(F.replace(F.replace(F.replace(page, F.lit("%3E"), F.lit(">")), F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    return F.when(page != "", plain)


def read_back(spark: SparkSession, out: str, id_type: str = "long") -> DataFrame:
    """A row per record in the files: page_id, payload_bytes, payload_digest, record_type, refers_to, header. Lengths and
    digests are those of the blocks read; a revisit gets them from the record it refers to. A digest that differs from
    the one its header states, or a missing record, fails the read."""
    seen = import_warc(spark, out, digest_only=True).select("header", "block_bytes", "block_sha1", field("WARC-Type").alias("record_type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("to"), F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:([0-9a-f]{40})$", 1).alias("said"))
    seen = written(seen)
    stored = seen.where("record_type = 'response'")
    whole = lambda digest: F.when(digest == F.col("said"), digest).otherwise(F.raise_error(F.lit("a record's payload is missing or differs")))
    first = stored.select("header", "record_type", "id", F.lit(None).cast("string").alias("to"), F.col("block_bytes").alias("payload_bytes"), whole(F.col("block_sha1")).alias("payload_digest"))
    again = spread_join(seen.where("record_type = 'revisit'").drop("block_bytes", "block_sha1"), stored.select(F.col("id").alias("to"), "block_bytes", "block_sha1"), "to")
    again = again.select("header", "record_type", "id", "to", F.col("block_bytes").alias("payload_bytes"), whole(F.col("block_sha1")).alias("payload_digest"))
    return first.unionByName(again).select(page_of(F.col("id")).cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("to")).cast(id_type).alias("refers_to"), "header")


def archived(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **options) -> DataFrame:
    """Write pages to an archive, rebuild its records as WARC files and read those back."""
    spark = pages.sparkSession
    path = path or work_dir(spark)
    write_archive(pages, path, id_col=id_col, **options)
    export_warc(spark, path, f"{path}/warc")
    return read_back(spark, f"{path}/warc", pages.schema[id_col].dataType.simpleString())
