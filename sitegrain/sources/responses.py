"""Landed responses: headers, bodies, certificates, robots and sitemap files, stream reading."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESPONSE_SCHEMA = (
    "site string, url string, final_url string, status int, error string, error_code string, content_type string,"
    " content_encoding string, headers map<string,string>, ttfb_ms int, total_ms int, transfer_bytes bigint, body binary,"
    " fetched_at timestamp, ord bigint, redirects array<struct<url:string,status:int,location:string>>,"
    " tls struct<protocol:string,cipher:string,subject:string,issuer:string,valid_from:timestamp,valid_to:timestamp,alt_names:array<string>>"
)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSE_SCHEMA).parquet(path)


def flatten_headers(raw: DataFrame, key: str = "url") -> DataFrame:
    """``(key, name, value, ord)`` rows to one lower-cased map per response; repeats are joined, cookies by line."""
    name = F.lower("name")
    one = raw.groupBy(key, name.alias("name")).agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("v"))
    joined = F.array_join(F.transform("v", lambda x: x["value"]), ", ")
    cookies = F.array_join(F.transform("v", lambda x: x["value"]), "\n")
    value = F.when(F.col("name") == "set-cookie", cookies).otherwise(joined)
    return one.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", value.alias("value")))).alias("headers"))


def charset_label(body: Column, content_type: Column) -> Column:
    """Charset named by the header, else by the first 4,096 bytes, lower-cased; empty when none is named."""
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    found = [
        F.regexp_extract(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w-]+)", 1),
        F.regexp_extract(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)", 1),
        F.regexp_extract(head, r"(?i)<\?xml[^>]+encoding=[\"']([\w-]+)", 1),
    ]
    return F.lower(F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.lit("")))


@F.pandas_udf(T.StringType())
def decode_other(body: pd.Series, label: pd.Series) -> pd.Series:
    """Bodies in charsets the JVM function refuses; an unknown label means UTF-8."""
    latin = {"iso-8859-1": "cp1252", "latin1": "cp1252", "ascii": "cp1252"}

    def one(data: bytes | None, name: str) -> str | None:
        if data is None:
            return None
        try:
            return bytes(data).decode(latin.get(name, name), errors="replace")
        except LookupError:
            return bytes(data).decode("utf-8", errors="replace")

    return pd.Series([one(b, n) for b, n in zip(body, label)])


def decode_body(responses: DataFrame, body: str = "body", content_type: str = "content_type", out: str = "html") -> DataFrame:
    """Decoded text, in one scan. UTF-8 stays in the JVM; the function gets nulls for all rows but those with another charset."""
    labelled = responses.withColumn("_label", charset_label(F.col(body), F.col(content_type)))
    plain = F.col("_label").isin("", "utf-8", "utf8")
    staged = labelled.withColumn("_text", F.when(plain, F.regexp_replace(F.try_validate_utf8(F.col(body).cast("string")), r"^\x{FEFF}", "")))
    odd = F.when(F.col("_text").isNull(), F.col(body))
    return staged.withColumn(out, F.coalesce("_text", decode_other(odd, F.col("_label")))).drop("_label", "_text")


def gunzip_bodies(rows: DataFrame, body: str = "body", out: str = "text", error: str | None = None) -> DataFrame:
    """Sitemap bodies as text; gzip is told by its magic bytes and may have several members, one after another.

    A member that is cut off or corrupt ends the text, so a file whose first member is broken is empty; the column ``error`` then says
    which. Zero bytes after the last member are padding. A missing body stays null.
    """
    unpacked = "text string, error string"

    @F.pandas_udf(unpacked)
    def unpack(data: pd.Series) -> pd.DataFrame:
        def one(raw: bytes | None) -> tuple[str | None, str | None]:
            if raw is None:
                return None, None
            rest, parts = bytes(raw), []
            while rest.strip(b"\0"):
                stream = zlib.decompressobj(31)
                try:
                    part = stream.decompress(rest)
                except zlib.error as broken:
                    return b"".join(parts).decode("utf-8", "replace"), f"corrupt: {broken}"
                if not stream.eof:
                    return b"".join(parts).decode("utf-8", "replace"), "truncated"
                parts.append(part)
                rest = stream.unused_data
            return b"".join(parts).decode("utf-8", "replace"), None

        return pd.DataFrame([one(x) for x in data], columns=["text", "error"])

    packed = F.coalesce(F.substring(F.col(body), 1, 2) == F.unhex(F.lit("1F8B")), F.lit(False))
    # one scan; the function gets nulls for all rows but the packed ones
    staged = rows.withColumn("_unpacked", unpack(F.when(packed, F.col(body))))
    staged = staged.withColumn(out, F.coalesce(F.when(~packed, F.make_valid_utf8(F.col(body).cast("string"))), F.col("_unpacked.text")))
    return (staged.withColumn(error, F.col("_unpacked.error")) if error else staged).drop("_unpacked")


def _xml_text(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    for entity, ch in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        out = F.replace(out, F.lit(entity), F.lit(ch))
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """``(site, sitemap, text)`` files to ``(site, sitemap, kind, ord, loc, lastmod)`` rows."""
    kind = F.when(F.col("text").rlike(r"(?i)<sitemapindex[\s>]"), "index").when(F.col("text").rlike(r"(?i)<urlset[\s>]"), "urlset").otherwise("unknown")
    blocks = F.when(F.col("kind") == "index", F.regexp_extract_all("text", F.lit(r"(?is)<sitemap[\s>].*?</sitemap>"), F.lit(0))).otherwise(
        F.regexp_extract_all("text", F.lit(r"(?is)<url[\s>].*?</url>"), F.lit(0)))
    rows = files.withColumn("kind", kind).select("site", "sitemap", "kind", F.posexplode(blocks).alias("ord", "block"))
    loc = F.regexp_extract("block", r"(?is)<loc>(.*?)</loc>", 1)
    lastmod = F.regexp_extract("block", r"(?is)<lastmod>(.*?)</lastmod>", 1)
    return rows.where(loc != "").select("site", "sitemap", "kind", "ord", _xml_text(loc).alias("loc"), F.when(lastmod != "", _xml_text(lastmod)).alias("lastmod"))


def certificate(tls: Column, as_of: Column) -> Column:
    """Certificate facts with whole days left."""
    left = F.floor((F.unix_timestamp(tls["valid_to"]) - F.unix_timestamp(as_of)) / 86400)
    return tls.withField("days_remaining", left)


def redirect_edges(responses: DataFrame) -> DataFrame:
    return responses.select("site", F.col("url").alias("requested"), F.posexplode("redirects").alias("hop", "r")).select("site", "requested", "hop", "r.*")


def read_events(spark: SparkSession, path: str, schema: str, stream: bool = False) -> DataFrame:
    """Newline-delimited JSON, as a table or as a stream; the last line needs no line end."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(schema).json(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files with front matter, one row per file."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.col("value").alias("raw"))
    return whole
