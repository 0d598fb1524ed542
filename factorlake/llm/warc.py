"""Web archives: writing records, and reading them back by putting segments together.

A record holds an HTTP response whose body is sent in chunks. A record longer
than `SEGMENT` is cut: its first part keeps the record type and says
`WARC-Segment-Number: 1`, the rest follow as `continuation` records that name the first
one in `WARC-Segment-Origin-ID`; the last tells `WARC-Segment-Total-Length`.
Of pages with one payload the one with the largest id is stored, the others become
`revisit` records that refer to it.

Archives are text files of Spark's own writer: a record is one row and ends with two
line breaks, so a lost task is written again by the usual commit. Reading takes
whole files, whose size is bounded by `RECORDS_PER_FILE` records of at most `SEGMENT`
payload bytes, walks them by `Content-Length`, and groups only the segmented records.

Defined results: null html is an empty payload. Each row is a record, also rows with equal id and
payload. A null id is written as an empty id and read back as null; it is never a keeper beside
another id.
"""

import gzip
import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import tuned

SEGMENT = 65_536
RECORDS_PER_FILE = 2_000
CHUNK = 16_384
REVISIT_BYTES = 1_000
BREAK = "\r\n"
SCHEMA = (
    "record_id string, record_type string, target string, digest string, refers_to string, origin string, "
    "segment int, total long, payload_bytes long, block binary"
)
ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "target", "digest", "refers_to", "origin")]
    + [("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("block", pa.binary())]
)
PAYLOADS = pa.schema(
    [(n, pa.string()) for n in ("page", "record_type", "refers_to", "target", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)


#: Parsed records that a reader hands over at once.
HANDED = 256


def keepers(pages: DataFrame, key: str, html: str, min_bytes: int) -> DataFrame:
    """(same, keeper): the largest id of each payload that more than one row holds."""
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    seen = pages.select(F.col(key).alias("id"), F.sha1(body).alias("same"), F.length(body).alias("n_bytes"))
    groups = seen.where(F.col("n_bytes") >= min_bytes).groupBy("same").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
    return groups.where("n > 1").select("same", "keeper")


def utf8_cut(block: bytes, size: int) -> list[bytes]:
    """Parts of at most `size` bytes that never cut a character."""
    parts, at = [], 0
    while at < len(block):
        end = min(at + size, len(block))
        while end < len(block) and block[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(block[at:end])
        at = end
    return parts


def framed(payload: bytes, chunk: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in utf8_cut(payload, chunk)) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions are skipped."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
        if len(out[-1]) != size or body[at - 2 : at] != b"\r\n":
            raise ValueError("a chunk is cut short")


def head(fields: dict) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in fields.items() if v is not None]
    return ("WARC/1.1\r\n" + "".join(lines) + "\r\n").encode()


def uri(page_id, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def records(page_id, url, payload: bytes, keeper, segment: int = SEGMENT) -> list[bytes]:
    """The record of one page or its segments, each without the line breaks that end it."""
    digest = hashlib.sha1(payload).hexdigest()
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "") or None
    common = {"WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}"}
    first = {"WARC-Record-ID": uri(page_id, digest)} | common
    if keeper is not None and keeper != page_id:
        fields = first | {"WARC-Type": "revisit", "WARC-Refers-To": uri(keeper, digest), "X-Payload-Length": len(payload)}
        return [head(fields | {"Content-Length": 0})]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    parts = utf8_cut(http + framed(payload), segment)
    out = []
    for n, part in enumerate(parts, 1):
        fields = first | {"WARC-Type": "response"}
        if n > 1:
            origin = uri(page_id, digest)
            fields = {"WARC-Record-ID": f"{origin[:-1]}:{n}>", "WARC-Type": "continuation", "WARC-Segment-Origin-ID": origin} | common
        if len(parts) > 1:
            fields["WARC-Segment-Number"] = n
        if n > 1 and n == len(parts):
            fields["WARC-Segment-Total-Length"] = sum(map(len, parts))
        out.append(head(fields | {"Content-Length": len(part)}) + part)
    return out


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, min_bytes: int = REVISIT_BYTES) -> None:
    """Archives of all pages under `path`, compressed, committed by Spark's text writer."""
    same = keepers(pages, key, html, min_bytes)
    body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("body"))
    rows = rows.withColumn("digest", F.when(F.length("body") >= min_bytes, F.sha1("body")))
    rows = rows.join(same, F.col("digest") == F.col("same"), "left").select("id", "url", "body", "keeper")

    def run(batches):
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            out = [r for page in zip(*columns, strict=True) for r in records(*page, segment)]
            for i in range(0, len(out), HANDED):
                yield pa.RecordBatch.from_arrays([pa.array(out[i : i + HANDED], pa.binary()).cast(pa.string())], names=["value"])

    made = tuned(pages.sparkSession) and rows.mapInArrow(run, "value string")
    writer = made.write.option("lineSep", BREAK * 2).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
    writer.text(path)


def parse(archive: bytes):
    """The records of one archive: (fields, block)."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split(BREAK)
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        at = start + int(fields["content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record before byte {at} has another length")
        yield fields, archive[start:at]
        at += 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of all archives under `path`, segments not yet put together."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for fields, block in parse(gzip.decompress(content.as_py())):
                    number = fields.get("warc-segment-number")
                    total = fields.get("warc-segment-total-length")
                    size = fields.get("x-payload-length")
                    rows.append({
                        "record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "target": fields.get("warc-target-uri"),
                        "digest": fields["warc-payload-digest"].removeprefix("sha1:"), "refers_to": fields.get("warc-refers-to"),
                        "origin": fields.get("warc-segment-origin-id", fields["warc-record-id"]), "segment": number and int(number),
                        "total": total and int(total), "payload_bytes": size and int(size), "block": block,
                    })
                    if len(rows) == HANDED:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    files = tuned(spark).read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, SCHEMA)


def reassemble(records: DataFrame) -> DataFrame:
    """Whole records: continuations are put behind their origin in order of their numbers, and the length is checked.

    Rows that are equal in id and payload have equal segments; these count once for the block and the
    record comes back as often as its first segment does.
    """
    whole = records.where("segment IS NULL").drop("origin", "segment", "total")
    part = F.struct("segment", "total", "block")
    groups = records.where("segment IS NOT NULL").groupBy("origin").agg(
        *[F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "target", "digest", "refers_to", "payload_bytes")],
        F.sum(F.when(F.col("segment") == 1, 1).otherwise(0)).alias("copies"),
        F.sort_array(F.collect_set(part)).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    # through hex digits: one pass however many segments there are
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    groups = groups.withColumn("block", block)
    good = (F.array_max(F.transform("parts", lambda p: p["total"])) == F.length("block")) & (numbers == F.sequence(F.lit(1), F.size("parts")))
    checked = F.when(good, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing of "), "origin")).cast("binary"))
    joined = groups.select(
        F.col("origin").alias("record_id"), "record_type", "target", "digest", "refers_to", "payload_bytes",
        checked.alias("block"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return whole.unionByName(joined.drop("copy"))


def payloads(records: DataFrame) -> DataFrame:
    """(page, record_type, refers_to, target, payload_digest, payload_bytes, payload) of whole records.

    The payload of a response is taken out of its chunks and held against its digest; a revisit has none,
    and tells the digest and length of what it stands for.
    """

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                page, refers = (x and x.removeprefix("<urn:page:").split(":")[0] for x in (r["record_id"], r["refers_to"]))
                payload, size = None, r["payload_bytes"]
                if r["record_type"] == "response":
                    payload = unframed(r["block"].partition(b"\r\n\r\n")[2])
                    size = len(payload)
                    if hashlib.sha1(payload).hexdigest() != r["digest"]:
                        raise ValueError(f"{r['record_id']} does not match its digest")
                rows.append((page, r["record_type"], refers, r["target"], r["digest"], size, payload))
            yield pa.RecordBatch.from_pydict(dict(zip(PAYLOADS.names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in PAYLOADS.names}, PAYLOADS)

    return records.select("record_id", "record_type", "refers_to", "target", "digest", "payload_bytes", "block").mapInArrow(
        run, "page string, record_type string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary"
    )


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Writes all pages into archives of the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, segment=segment)
    return payloads(reassemble(read_records(spark, path)))
