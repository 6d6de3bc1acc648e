"""WARC archives: writing, reading, and revisit resolution.

Archives are gzip files that Spark's text writer and reader handle, so they can lie in any store that Spark reaches; a record
is one row.  The reader splits a file where ``\\r\\n\\r\\nWARC/1.`` stands and then goes by Content-Length: a payload
that holds these very bytes is put together again.

Resolution shuffles headers only: (digest, rank) are reduced to each digest's original, and revisits are
joined to the originals.  What is decided about the records of an archive is gathered by archive; archives are rewritten in groups,
each with the decisions of its own archives at hand, a bounded number, so that payloads go from the old archive to
the new one within a task.  Fresh headers are written, payloads of revisits left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import free, materialize, shared_dir, table

VERSION = b"WARC/1.1\r\n"
BREAK = b"\r\n\r\nWARC/1."  # of versions 1.0 and 1.1
#: Records that become revisits, whose ids are broadcast with a group of archives (some 200 bytes each).  One archive may exceed it.
DECISIONS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEADS = "record_id string, record_type string, uri string, date string, digest string, refers_to string, length long, computed string, file string"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; a line break inside a value would start a new header, so it is escaped."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def write_warc(records: DataFrame, path: str, *, mode: str = "error") -> None:
    """Write (record_id, record_type, uri, date, digest, refers_to, payload binary) as WARC/1.1 files under ``path``.

    ``digest`` is bare hex SHA-1.  A response's block is an HTTP response head and the payload (null: empty); a revisit's
    block is the head alone.  Null header values leave their lines out.
    """
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("payload", F.lit(b""))).cast("string"), F.lit("\r\n\r\n"))
    lines = F.concat(
        F.lit(VERSION.decode()), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("uri")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")), _line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))), F.lit("Content-Type: application/http; msgtype=response\r\n"), _line("Content-Length", F.octet_length(head) + F.octet_length(body)), F.lit("\r\n"), head,
    )
    whole = F.concat(lines.cast("binary"), body, F.lit(b"\r\n"))
    records.select(whole.cast("string").alias("value")).write.mode(mode).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n").text(path)


class _Reader:
    """Puts records together from the fragments of a file, in order; the fragments of a record are joined once."""

    def __init__(self) -> None:
        self.file, self.parts, self.have, self.need = None, [], 0, 0

    def feed(self, file: str, fragment: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """(headers, HTTP head, payload) of the records that end with this fragment: none, one, or, if a payload ends like a separator, more."""
        if file != self.file:
            self.close()
            self.file = file
            fragment = fragment.removeprefix(BREAK.strip())
        elif self.parts:
            fragment = BREAK + fragment
        self.parts.append(fragment)
        self.have += len(fragment)
        if self.have < self.need:
            return
        data, at = b"".join(self.parts), 0
        self.parts, self.have, self.need = [], 0, 0
        while True:
            head = data.find(b"\r\n\r\n", at)
            lines = data[at : max(head, at)].decode("utf-8", "replace").split("\r\n")[1:]  # the first has the rest of the version
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            start = head + 4
            stop = start + int(headers.get("content-length", "0"))
            if head < 0 or len(data) < stop:
                self.parts, self.have, self.need = [data[at:]], len(data) - at, stop - at if head >= 0 else 0
                return
            http, payload = b"", data[start:stop]
            if headers.get("content-type", "").startswith("application/http"):
                http, _, payload = payload.partition(b"\r\n\r\n")
            yield headers, http, payload
            if not data.startswith(BREAK, stop):
                return
            at = stop + len(BREAK)

    def close(self) -> None:
        if self.parts:
            raise ValueError(f"{self.file}: the last record is cut short")


def read_warc(spark: SparkSession, path: str | list[str], *, payload: bool = False) -> DataFrame:
    """Records of all archives under ``path``: the header fields, the payload's length and computed SHA-1, the archive, and, if asked for, the payload.

    A record without payload (a revisit) has length and computed digest null.  An archive that ends within a record is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, rows, size = _Reader(), [], 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payload
        names = [c.split()[0] for c in HEADS.split(", ")] + ["payload"] * payload
        bare = lambda v: v.strip("<>") if v else None
        for b in batches:
            for file, fragment in zip(b.column(0), b.column(1), strict=True):
                for h, _, body in reader.feed(file.as_py(), fragment.as_py()):
                    kept = h.get("warc-type") != "revisit"
                    row = (bare(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), (h.get("warc-payload-digest") or "").rpartition(":")[2] or None, bare(h.get("warc-refers-to")), len(body) if kept else None, hashlib.sha1(body).hexdigest() if kept else None, file.as_py())
                    rows.append((*row, body if kept else None) if payload else row)
                    size += len(body) * payload + 200
                    if size > 4 << 20:
                        yield flush()
                        rows.clear()
                        size = 0
        reader.close()
        if rows:
            yield flush()

    lines = spark.read.option("lineSep", BREAK.decode()).text(path)
    lines = lines.select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))
    return lines.mapInArrow(run, HEADS + ", payload binary" * payload)


def page_records(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Response records of crawled pages; the id ends with the page's id ('null' for a null one) and holds the digest."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    digest = F.sha1(payload)
    rid = F.concat(F.lit("urn:page:"), digest, F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return pages.select(rid.alias("record_id"), F.lit("response").alias("record_type"), F.col(uri_col).alias("uri"), F.lit(DATE).alias("date"), digest.alias("digest"), F.lit(None).cast("string").alias("refers_to"), payload.alias("payload"))


def page_id(record_id: Column) -> Column:
    """The page's id at the end of a record id; null if there is none."""
    return F.substring_index(record_id, ":", -1).try_cast("long")


def resolve_revisits(spark: SparkSession, source: str, target: str, *, min_bytes: int = 1000) -> None:
    """Rewrite the archives under ``source`` to ``target`` without repeated payloads.

    Of responses with equal payloads of at least ``min_bytes`` bytes the one with the largest page id stays (several rows of
    that very id all stay); the others become revisits of it.  Records without a page id come last.  Revisits that
    the source already holds are pointed at the response of their digest; one without such a response is kept as it is.
    An empty archive gives an empty one.
    """
    heads = materialize(read_warc(spark, source).withColumn("rank", page_id(F.col("record_id"))), "warc-heads")
    response = F.col("record_type") != "revisit"
    long_ones = heads.where(response & (F.col("length") >= min_bytes))
    originals = long_ones.groupBy(F.col("computed").alias("original_digest")).agg(F.max(F.struct(F.col("rank").isNotNull().alias("known"), "rank", "record_id")).alias("top"), F.count("*").alias("n"))
    originals = originals.join(heads.where(~response).select(F.col("digest").alias("original_digest")).distinct().withColumn("asked", F.lit(True)), "original_digest", "left").where("n > 1 or asked")
    digest = F.when(response, F.col("computed")).otherwise(F.col("digest"))
    asks = heads.where(~response | (F.col("length") >= min_bytes)).select("file", "record_id", "rank", digest.alias("original_digest"), response.alias("own"))
    decided = asks.join(originals, "original_digest").where("not own or (record_id != top.record_id and not (rank <=> top.rank))")
    decided = materialize(decided.select("file", "record_id", F.col("top.record_id").alias("original")).distinct(), "warc-decisions")
    counts = heads.select("file").distinct().join(decided.groupBy("file").agg(F.count("*").alias("n")), "file", "left").orderBy("file").collect()  # one row per archive
    free(heads)
    for archives in _archive_groups([(r["file"], r["n"] or 0) for r in counts]):
        own = decided.where(F.col("file").isin(archives)) if len(archives) < len(counts) else decided
        records = read_warc(spark, [unquote(f) for f in archives], payload=True).join(F.broadcast(own), ["file", "record_id"], "left")
        gone = F.col("original").isNotNull()
        fresh = records.select(
            "record_id", F.when(gone, F.lit("revisit")).otherwise(F.col("record_type")).alias("record_type"), "uri", "date",
            F.coalesce("computed", "digest").alias("digest"), F.coalesce("original", "refers_to").alias("refers_to"), "payload",
        )
        write_warc(fresh, target, mode="append")
    if not counts:
        write_warc(read_warc(spark, source, payload=True), target)
    free(decided)


def _archive_groups(counts: list[tuple[str, int]], most: int | None = None) -> Iterator[list[str]]:
    """Archives (name, decisions) in groups of at most ``most`` decisions; one that has more is a group of its own."""
    group, held = [], 0
    for name, n in counts:
        if group and held + n > (most or DECISIONS):
            yield group
            group, held = [], 0
        group.append(name)
        held += n
    if group:
        yield group


def resolved(heads: DataFrame) -> DataFrame:
    """Headers of an archive, every revisit with the length and digest of the response that it refers to (null if that is missing)."""
    own = heads.where("record_type != 'revisit'")
    seen = own.select(F.col("record_id").alias("refers_to"), F.col("length").alias("l"), F.col("computed").alias("c")).distinct()
    again = heads.where("record_type = 'revisit'").drop("length", "computed").join(seen, "refers_to", "left")
    return own.unionByName(again.withColumnsRenamed({"l": "length", "c": "computed"}))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    crawled, kept = shared_dir(spark, "warc-crawled"), shared_dir(spark, "warc-kept")
    write_warc(page_records(table(spark, sf_dir, "pages")), crawled)
    resolve_revisits(spark, crawled, kept)
    heads = resolved(materialize(read_warc(spark, kept), "warc-read"))
    return heads.select(
        page_id(F.col("record_id")).alias("page_id"), F.col("length").alias("payload_bytes"), F.col("computed").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", page_id(F.col("refers_to"))).alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     g AS (SELECT page_id, strlen(body) AS n, sha1(body) AS digest, max(page_id) OVER (PARTITION BY body) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""
