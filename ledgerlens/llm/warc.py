"""Not-modified revisits of web archives, resolved to the responses that they stand for.

A revisit record (``server-not-modified``, status 304) has no payload. It is joined as of
its date to the latest earlier full response for the same canonical URL, takes that
response's payload by reference where the validators agree, and gets the response's headers,
replaced by those that a 304 may carry.

The as-of join is a union and two windows over time buckets: the last full response in each
(URL, bucket) is carried forward over the buckets, then within a bucket, so captures of one
very frequent URL are spread over tasks. Only ids and headers move; payloads stay where
they are until ``attach_payload``.

Defined results: a null or malformed URL is its own canonical form (null stays null and
resolves to nothing); a response of the same date and a lower id counts as earlier; with no
earlier response the outcome is ``no_response``; where both records have an ETag, these
decide (weak comparison), else Last-Modified; without a validator on both sides the outcome
is ``no_validator``; where they differ, ``mismatch``; repeated records are resolved alike;
null headers count as none; no rows give no rows; other columns pass.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: headers that a 304 response may update; all others stay as they were (fixed values)
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: query parameters that don't select content (fixed values)
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid)"
SECONDS_A_BUCKET = 86_400


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, fragment, tracking parameters and a final slash; host lowered."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"(?s)#.*$", ""), rf"([?&]){TRACKING}=[^&]*", "$1")
    bare = F.regexp_replace(F.regexp_replace(bare, r"&{2,}", "&"), r"\?&+", "?")
    bare = F.regexp_replace(bare, r"[?&]+$", "")
    host = F.lower(F.regexp_extract(bare, r"(?is)^[a-z][a-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(host, r":(80|443)$", "")
    rest = F.regexp_extract(bare, r"(?is)^[a-z][a-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(host == "", url).otherwise(F.concat(host, F.regexp_replace(rest, r"/+$", "")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r'^[Ww]/', "")


def resolve_revisits(records: DataFrame, seconds: int = SECONDS_A_BUCKET) -> DataFrame:
    """Add ``canonical``, ``refers_to``, ``outcome`` and ``merged_headers`` to every record.

    Columns: record_id long, kind string (response or revisit), url string, captured_at
    timestamp, headers map<string,string> with lower-case names. For a response the outcome
    is ``response``, it refers to itself and keeps its headers.
    """
    own = [c for c in records.columns if c not in ("canonical", "refers_to", "outcome", "merged_headers")]
    rows = records.select(*[F.col(f"`{c}`") for c in own]).withColumn("canonical", canonical_url(F.col("url")))
    at = F.unix_micros(F.col("captured_at").cast("timestamp"))
    rows = rows.withColumn("_at", F.coalesce(at, F.lit(0))).withColumn("_bucket", F.floor(F.col("_at") / (1_000_000 * seconds)))
    full = F.when(F.col("kind") == "response", F.struct(F.col("_at"), F.col("record_id").alias("id"), F.coalesce("headers", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers")))
    rows = rows.withColumn("_full", full)
    lasts = rows.where(F.col("_full").isNotNull() & F.col("canonical").isNotNull()).groupBy("canonical", "_bucket").agg(F.max_by("_full", F.struct("_at", "record_id")).alias("_last"))
    # buckets of a URL that hold captures, each with the last response of earlier ones
    buckets = rows.where(F.col("canonical").isNotNull()).select("canonical", "_bucket").distinct().join(lasts, ["canonical", "_bucket"], "left")
    before = Window.partitionBy("canonical").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("canonical", "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("canonical", "_bucket").orderBy("_at", "record_id", F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_near", F.last("_full", ignorenulls=True).over(within))
    rows = rows.join(buckets, ["canonical", "_bucket"], "left").withColumn("_from", F.when(F.col("canonical").isNotNull(), F.coalesce("_near", "_carried")))

    mine = F.coalesce("headers", F.col("_full.headers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    tag, base_tag = _weak(mine["etag"]), _weak(F.col("_from.headers")["etag"])
    date, base_date = F.trim(mine["last-modified"]), F.trim(F.col("_from.headers")["last-modified"])
    same = F.when(tag.isNotNull() & base_tag.isNotNull(), tag == base_tag).when(date.isNotNull() & base_date.isNotNull(), date == base_date)
    outcome = F.when(F.col("kind") == "response", "response").when(F.col("_from").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("mismatch")
    rows = rows.withColumn("outcome", outcome)
    updates = F.map_filter(mine, lambda k, v: k.isin(*UPDATED))
    kept = F.map_filter(F.col("_from.headers"), lambda k, v: ~F.map_contains_key(updates, k))
    merged = F.when(F.col("kind") == "response", mine).when(F.col("outcome") == "resolved", F.map_concat(kept, updates))
    refers = F.when(F.col("kind") == "response", F.col("record_id")).when(F.col("outcome") == "resolved", F.col("_from.id"))
    return rows.select(*own, "canonical", refers.alias("refers_to"), "outcome", merged.alias("merged_headers"))


def attach_payload(resolved: DataFrame, records: DataFrame, payload: str = "payload") -> DataFrame:
    """Resolved records with the payload of the response that they refer to."""
    source = records.where(F.col("kind") == "response").select(F.col("record_id").alias("refers_to"), F.col(payload))
    return resolved.drop(payload).join(source, "refers_to", "left")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (plain or gzip), in the columns of ``resolve_revisits`` with payload."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, data in zip(f["path"], f["content"]):
                rows = [(name, n, *r) for n, r in enumerate(parse_warc(bytes(data)))]
                yield pd.DataFrame(rows, columns=["file", "number", "kind", "url", "captured_at", "status", "headers", "payload"])

    schema = "file string, number int, kind string, url string, captured_at string, status int, headers map<string,string>, payload binary"
    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    return rows.select(F.xxhash64("file", "number").alias("record_id"), "kind", "url", F.try_to_timestamp("captured_at").alias("captured_at"), "status", "headers", "payload")


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def parse_warc(data: bytes) -> list[tuple]:
    """(kind, url, date, status, headers, payload) of the response and revisit records."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    stream, out = io.BytesIO(data), []
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        fields = _fields(head)
        block = stream.read(int(fields.get("content-length", 0)))
        if fields.get("warc-type") in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            first, *rest = top.split(b"\r\n")
            parts = first.split()
            status = int(parts[1]) if len(parts) > 1 and parts[1].isdigit() else None
            out.append((fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-date"), status, _fields(rest), body))
    return out
