"""A content-addressed WARC archive: payload bytes once for each digest, exact record
headers apart, and the records by joining the two.

Three tables make an archive: ``payloads`` (sha256, body), ``responses`` (page_id, sha256,
header) and ``revisits`` (page_id, sha256, header), where ``header`` holds a record's header
block to the last byte. A record of a payload that another record holds is a revisit: its
block is empty, and its header refers to the response. Payloads and responses are bucketed
by the digest, so that putting records together moves no payload. Reading takes records
apart by their own lengths, and verifies payloads against both digests.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, staged, staged_path, table

# Digits of base 32 by RFC 4648, and those that conv() writes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass
class Archive:
    responses: DataFrame
    revisits: DataFrame
    payloads: DataFrame
    tables: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()

    @property
    def records(self) -> DataFrame:
        return self.responses.unionByName(self.revisits)

    def drop(self) -> None:
        """Remove the archive: its tables from the catalogue, and its files."""
        spark = self.revisits.sparkSession
        for name in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_staged(spark, *self.paths)


def bucketed(df: DataFrame, name: str) -> tuple[DataFrame, str, str]:
    """``df``, dealt by the digest, as a table in the shared folder with a file for each
    digest bucket; its name and its path. Rows of a bucket are in one task, whose file is
    then the bucket's only one."""
    spark = df.sparkSession
    n, table_, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"barlab_{name}_{uuid.uuid4().hex}", staged_path(spark, name)
    df.write.bucketBy(n, "sha256").sortBy("sha256").option("path", path).saveAsTable(table_)
    return spark.table(table_), table_, path


def end_mark() -> Column:
    return F.unhex(F.lit("0D0A0D0A"))  # two line ends behind each record


def base32_sha1(body: Column) -> Column:
    """Upper-case base-32 SHA-1: each five hex digits of it are four of base 32."""
    digits = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(digits, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def header(page: Column, url: Column, date: Column, refers_to: Column, digest: Column, size: Column) -> Column:
    """The header block of a response, or of a revisit where ``refers_to`` is not null."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    target = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")
    revisit = refers_to.isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id(page)), line("WARC-Date", date),
        line("WARC-Target-URI", target), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_id(refers_to)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.when(revisit, F.lit(0)).otherwise(size).cast("string")), F.lit(CRLF),
    )


def write_archive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date_col: str | None = None, captured: str = "1970-01-01T00:00:00Z", least_bytes: int = 0) -> Archive:
    """One record for each row of ``pages``.

    Of the records of equal payloads of at least ``least_bytes`` bytes, those of the largest
    id are responses and the others revisits; smaller payloads are all responses. A null
    payload is empty, a null URL an empty header value. ``date_col`` has the times of
    capture; without it, or where it is null, a record is dated ``captured``. Null ids are
    smaller than any other; where all are null, and for rows that repeat the largest id,
    each is a response. Other columns are ignored. Each payload goes through one shuffle in
    which equal ones combine; nothing else of its size is moved.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    date = F.lit(captured) if date_col is None else F.coalesce(F.date_format(F.col(date_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(captured))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), date.alias("date"), body.alias("body")).withColumn("sha256", F.sha2("body", 256))
    payloads, *payloads_at = bucketed(rows.groupBy("sha256").agg(F.first("body").cast("binary").alias("body")), "payloads")
    facts = rows.select("page_id", "url", "date", "sha256", F.octet_length("body").alias("size"), base32_sha1(F.col("body")).alias("digest"))
    latest = facts.groupBy("sha256").agg(F.max("page_id").alias("response"))
    other = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("response"))
    refers_to = F.when(other, F.col("response"))
    records = facts.join(latest, "sha256").select("page_id", "sha256", refers_to.isNotNull().alias("again"), header(F.col("page_id"), F.col("url"), F.col("date"), refers_to, F.col("digest"), F.col("size")).cast("binary").alias("header"))
    records, records_at = staged(records, "records")
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    responses, *responses_at = bucketed(records.filter("not again").drop("again").repartition(buckets, "sha256"), "responses")
    revisits, revisits_at = staged(records.filter("again").drop("again"), "revisits")
    drop_staged(pages.sparkSession, records_at)
    return Archive(responses, revisits, payloads, (payloads_at[0], responses_at[0]), (payloads_at[1], responses_at[1], revisits_at))


def verified_payloads(archive: Archive) -> DataFrame:
    """(sha256, body); stops at a payload whose bytes do not have the digest it is kept by."""
    good = F.sha2("body", 256) == F.col("sha256")
    return archive.payloads.select("sha256", F.when(good, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))).cast("binary")).alias("body"))


def original_records(archive: Archive) -> DataFrame:
    """(page_id, record): the bytes of each record, its header, block and end mark; the
    block of a response is its payload, that of a revisit is empty."""
    whole = archive.responses.join(verified_payloads(archive), "sha256").select("page_id", F.concat("header", "body", end_mark()).alias("record"))
    return whole.unionByName(archive.revisits.select("page_id", F.concat("header", end_mark()).alias("record")))


def parsed(records: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, noted, block) of record bytes: the header ends at
    the first empty line, the block is as long as it says, and the end mark follows. Records
    that are not built so stop the query."""
    head = F.substring_index(F.col("record").cast("string"), CRLF * 2, 1)
    rows = records.withColumn("head", head).withColumn("at", F.octet_length("head") + 5)
    field = lambda name: F.nullif(F.regexp_extract(F.concat("head", F.lit(CRLF)), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    page = lambda name: F.regexp_extract(field(name), "<urn:page:([^>]*)>", 1)
    kind = records.schema["page_id"].dataType
    rows = rows.withColumn("length", field("Content-Length").cast("int"))
    sound = F.col("head").startswith("WARC/1.") & field("WARC-Date").isNotNull() & (F.expr("substring(record, at + length)") == end_mark())
    block = F.when(F.coalesce(sound, F.lit(False)), F.expr("substring(record, at, length)")).otherwise(F.raise_error(F.lit("damaged record")).cast("binary"))
    return rows.select(F.nullif(page("WARC-Record-ID"), F.lit("null")).cast(kind).alias("page_id"), field("WARC-Type").alias("record_type"), F.nullif(page("WARC-Refers-To"), F.lit("")).cast(kind).alias("refers_to"), field("WARC-Payload-Digest").alias("noted"), block.alias("block"))


def read_archive(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the records put
    together again and taken apart. A response's digest is taken anew and held against its
    header; a revisit has the digest that it notes, and the length of that payload."""
    rows = parsed(original_records(archive)).select("page_id", "record_type", "refers_to", "noted", F.octet_length("block").cast("bigint").alias("payload_bytes"), base32_sha1(F.col("block")).alias("digest"))
    rows, _ = staged(rows, "read")
    own = rows.filter("record_type = 'response'")
    same = F.col("noted") == F.concat(F.lit("sha1:"), F.col("digest"))
    digest = F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("header and payload disagree")).cast("string"))
    own = own.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
    sizes = own.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    again = rows.filter("record_type = 'revisit'").select("page_id", F.substring("noted", 6, 32).alias("payload_digest"), "record_type", "refers_to").join(sizes, "payload_digest")
    return own.unionByName(again)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Every page's record, written to an archive and read back."""
    archive = write_archive(table(spark, sf_dir, "pages"))
    out = read_archive(archive)  # staged, so that the archive is not needed any more
    archive.drop()
    return out


_DIGIT = lambda i, k: f"substr('{BASE32}', (((('0x' || substr(h, {5 * i + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31) + 1)::INTEGER, 1)"
OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS response FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
       {' || '.join(_DIGIT(i, k) for i in range(8) for k in range(4))} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM m
"""
