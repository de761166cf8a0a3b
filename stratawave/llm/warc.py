"""WARC archives as chunked record tables.

A payload is cut into rows (page, chunk number, bytes); each chunk becomes a
WARC record of its own (the first a response, later ones continuations), so
neither writer nor reader ever holds an oversized record. Cuts inside every
version string keep a payload from looking like the start of a record, so Spark's
text reader can split the archives (WARC text, gzip-compressed unless asked
otherwise) into records. Reading back, whole payloads are verified by digests
carried incrementally from chunk to chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship

EOL = "\r\n"
VERSION = "WARC/1.1"
#: What separates records on disk; the reader splits on it.
DELIMITER = f"{EOL}{EOL}{VERSION}{EOL}"
DATE = "2000-01-01T00:00:00Z"


def plan_records(pages: DataFrame, min_revisit_bytes: int = 100) -> DataFrame:
    """One row per page_id: page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response).

    Of rows that repeat a page_id, the one of the smallest digest, then of the smallest url, is the page.
    """
    p = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    ids = p.groupBy("page_id").agg(F.min(F.struct("payload_digest", "payload_bytes")).alias("own")).select("page_id", "own.*")
    first = ids.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    refers = ids.join(first, ["payload_digest", "payload_bytes"], "left").select("page_id", "payload_digest", F.when(F.col("page_id") > F.col("first_id"), F.col("first_id")).alias("refers_to"))
    rows = p.join(refers, ["page_id", "payload_digest"]).groupBy("page_id", "payload_digest").agg(F.min(F.struct("url", "payload", "payload_bytes", "refers_to")).alias("page"))
    return rows.select("page_id", "page.url", "page.payload", "page.payload_bytes", "payload_digest", "page.refers_to")


def chunk_bounds(payload: Column, size: int) -> Column:
    """Starts of the chunks (0-based): multiples of size, and a cut inside every version string in the payload (the writer's separator makes one at a chunk's end a line)."""
    text, line = payload.cast("string"), VERSION
    parts = F.transform(F.split(text, line.replace(".", "\\."), -1), lambda x: F.octet_length(x))
    ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n + len(line))))
    inside = F.transform(F.slice(ends, 2, F.greatest(F.size(ends) - 2, F.lit(0))), lambda e: e - len(line) // 2)
    regular = F.sequence(F.lit(0), F.greatest(F.octet_length(payload) - 1, F.lit(0)), F.lit(size))
    return F.when(F.contains(text, F.lit(line)), F.array_sort(F.array_union(regular, inside))).otherwise(regular)


def chunk_table(records: DataFrame, size: int = 64 * 1024) -> DataFrame:
    """Rows (page_id, segment, last, data and what headers need), one per chunk; a revisit is one row without data."""
    r = records.withColumn("starts", F.when(F.col("refers_to").isNull(), chunk_bounds(F.col("payload"), size)).otherwise(F.array(F.lit(0))))
    r = r.select("*", F.posexplode("starts").alias("pos", "start"))
    stop = F.coalesce(F.get("starts", F.col("pos") + 1), F.octet_length("payload"))
    return r.select(
        "page_id", "url", "payload_bytes", "payload_digest", "refers_to", (F.col("pos") + 1).alias("segment"), (F.size("starts") == F.col("pos") + 1).alias("last"),
        F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("start") + 1, stop - F.col("start"))).otherwise(F.lit(b"")).alias("data"),
    )


def record_text(chunks: DataFrame) -> DataFrame:
    """The record of each chunk, without its leading version line and trailing blank lines (the writer's separator adds both)."""
    head = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.lit(EOL))
    rid = lambda page, seg: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(":"), seg.cast("string"), F.lit(">"))
    page, seg = F.col("page_id"), F.col("segment")
    kind = F.when(F.col("refers_to").isNotNull(), "revisit").when(seg > 1, "continuation").otherwise("response")
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:none")), "[\\x00-\\x20\\x7f]", "_")
    http = F.when(seg == 1, F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(EOL + EOL))).otherwise("")
    block = F.concat(http.cast("binary"), F.col("data"))
    several = (seg > 1) | ~F.col("last")
    headers = F.concat(
        head("WARC-Type: ", kind), head("WARC-Record-ID: ", rid(page, seg)), head("WARC-Date: ", DATE), head("WARC-Target-URI: ", url),
        head("Content-Type: application/http;msgtype=response"),
        head("WARC-Payload-Digest: sha256:", F.col("payload_digest")), head("WARC-Block-Digest: sha256:", F.sha2(block, 256)),
        F.when(F.col("refers_to").isNotNull(), F.concat(head("WARC-Refers-To: ", rid(F.col("refers_to"), F.lit(1))), head("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(several, head("WARC-Segment-Number: ", seg)).otherwise(""),
        F.when(seg > 1, head("WARC-Segment-Origin-ID: ", rid(page, F.lit(1)))).otherwise(""),
        F.when(several & F.col("last"), head("WARC-Segment-Total-Length: ", F.col("payload_bytes"))).otherwise(""),
        head("Content-Length: ", F.octet_length(block)),
    )
    return chunks.select(F.concat(F.lit(VERSION + EOL).cast("binary"), headers.cast("binary"), F.lit(EOL).cast("binary"), block).cast("string").alias("value"))


def write_warc(pages: DataFrame, path: str, chunk_bytes: int = 64 * 1024, records_per_file: int = 100_000, compression: str = "gzip") -> None:
    """Write one WARC record per page (several for payloads over chunk_bytes) below path.

    Equal payloads of at least 100 bytes: the smallest page_id is the response,
    others revisit it. Null html is an empty payload, null urls become urn:none.
    Rows without page_id are left out; of rows that repeat a page_id one is written
    (plan_records); other columns are ignored; an empty table gives no records.
    """
    text = record_text(chunk_table(plan_records(pages), chunk_bytes))
    text.write.option("lineSep", EOL + EOL).option("maxRecordsPerFile", records_per_file).option("compression", compression).text(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Record headers and blocks: page_id, segment, last, record_type, refers_to, http_bytes, digest, block_ok, data."""
    raw = spark.read.option("lineSep", DELIMITER).text(path).select(F.col("value").cast("binary").alias("raw"))
    text = F.col("raw").cast("string")
    raw = raw.withColumn("head", F.substring_index(text, EOL + EOL, 1))
    field = lambda name: F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)", 1)
    size = field("Content-Length").cast("int")
    r = raw.select(
        F.regexp_extract(field("WARC-Record-ID"), r"page:(-?\d+):", 1).cast("long").alias("page_id"), F.regexp_extract(field("WARC-Record-ID"), r":(\d+)>", 1).cast("int").alias("segment"),
        field("WARC-Type").alias("record_type"), F.regexp_extract(field("WARC-Refers-To"), r"page:(-?\d+):", 1).alias("refers"), field("WARC-Segment-Number").alias("part"),
        field("WARC-Segment-Total-Length").alias("total"), F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"), F.substring_index(field("WARC-Block-Digest"), ":", -1).alias("block_digest"),
        F.substring("raw", F.octet_length("head") + 5, size).alias("block"),
    )
    http = F.when(F.col("segment") == 1, F.octet_length(F.substring_index(F.col("block").cast("string"), EOL + EOL, 1)) + 4).otherwise(0)
    return r.select(
        "page_id", "segment", "record_type", F.expr("try_cast(refers as long)").alias("refers_to"), "digest", (F.sha2("block", 256) == F.col("block_digest")).alias("block_ok"),
        ((F.col("part") == "") | (F.col("total") != "")).alias("last"), F.substring("block", http + 1, F.lit(2**31 - 1)).alias("data"),
    )


JOINED = "page_id long, payload_bytes long, payload_digest string, digest_ok boolean"


def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payload length and digest of records whose rows arrive by (page_id, segment): only the running hash is kept."""
    page, size, running, want = None, 0, hashlib.sha256(), None

    def flush():
        return {"page_id": page, "payload_bytes": size, "payload_digest": running.hexdigest(), "digest_ok": running.hexdigest() == want}

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_())])
    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            own = batch.column(0)[k].as_py()
            if own != page:
                if page is not None:
                    done.append(flush())
                page, size, running, want = own, 0, hashlib.sha256(), batch.column(2)[k].as_py()
            data = batch.column(3)[k].as_buffer()
            size += data.size
            running.update(data)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if page is not None:
        yield pa.RecordBatch.from_pylist([flush()], schema)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Per page, read from the archives: page_id, payload_bytes, payload_digest (of the full payload, also for revisits), record_type, refers_to, verified."""
    ship(spark)
    r = read_records(spark, path)
    kind = r.where("segment = 1").select("page_id", "record_type", "refers_to")
    single = r.where("segment = 1 and last and record_type = 'response'").select("page_id", F.octet_length("data").cast("long").alias("payload_bytes"), F.sha2("data", 256).alias("payload_digest"), (F.col("block_ok") & (F.sha2("data", 256) == F.col("digest"))).alias("digest_ok"))
    parts = r.where("record_type <> 'revisit' and not (segment = 1 and last)").select("page_id", "segment", "digest", "data")
    several = parts.repartition("page_id").sortWithinPartitions("page_id", "segment").mapInArrow(join_segments, JOINED)
    whole = single.unionByName(several)
    own = kind.where("record_type = 'response'").join(whole, "page_id")
    again = kind.where("record_type = 'revisit'").join(whole.withColumnRenamed("page_id", "refers_to"), "refers_to")
    return own.unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("digest_ok").alias("verified"))
