"""Pages as WARC records, with a revisit for each repeated payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlane.llm import warc
from eventlane.llm.common import shared_path

# Fixed value: record ids are this with the page's number.
ID_PREFIX = "urn:page:"


def page_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """WARC records of pages: of equal payloads of ``least`` bytes or more, the page of largest id is the response.

    A null html is an empty payload; a page with a null id is never what others
    refer to; rows that repeat the largest id are all responses. Extra columns
    are ignored; an empty table gives no records.
    """
    own = pages.select(
        F.col(id_col).alias("page"), F.col(url).alias("target_uri"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("body"),
    )
    own = own.withColumn("payload_digest", F.sha1("body")).withColumn("payload_length", F.octet_length("body").cast("long"))
    # Digests are counted before they move; only repeated ones are joined, and each is one row.
    first = (
        own.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.max("page").alias("original"), F.count("*").alias("copies"))
        .where("copies > 1 and original is not null").select(F.col("payload_digest").alias("of"), "original")
    )
    joined = own.join(first, own["payload_digest"] == first["of"], "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page"))
    name = lambda c: F.concat(F.lit(ID_PREFIX), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return joined.select(
        name("page").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.lit("2024-01-01T00:00:00Z").alias("date"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.when(~revisit, F.col("body")).alias("payload"), "payload_length", "payload_digest",
        F.when(revisit, name("original")).alias("refers_to"),
    )


def archived(records: DataFrame, **options: str) -> str:
    """Write records to a new folder of archives below the shared folder; gives its path."""
    spark = records.sparkSession
    warc.register(spark)
    path = shared_path(spark, "archives")
    records.write.format("warc").options(**options).mode("append").save(path)
    return path


def page_rows(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of records as ``page_records`` makes them.

    A response is measured by its payload, a revisit told by its headers.
    """
    number = lambda c: F.expr(f"try_cast(substr({c}, {len(ID_PREFIX) + 1}) as bigint)")
    response = F.col("record_type") == "response"
    return archives.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
