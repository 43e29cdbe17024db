"""A WARC archive addressed by content: exact headers in one table, each payload once in another, records by their join.

1. Payloads are addressed by their SHA-256.  Only ids, addresses and lengths meet in a first aggregation, which names the
   record that holds the payload of each address and how many records share it; a payload of a third of all records is a
   counter there.
2. A payload that one record has goes to the store from where it is read.  Of those that repeat, the bytes of the first
   record are stored, and the bytes of all others are compared with them: the digest is verified, not trusted.
3. Headers are written with the address.  Records that repeat a payload (of ``least`` bytes or more) are revisits of the
   first one.
4. Reading joins headers to payloads and digests what it has read again.  A payload of many records is dealt to as many
   slots as its number of records asks for (``SLOT`` in each), so no task gets all of them.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, lean, materialise

#: Records that meet one copy of a payload when records are put together.
SLOT = 10_000
#: Fixed values of the format.
VERSION, BREAK, END = "WARC/1.1", "\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def sha256(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", body_col: str = "html") -> DataFrame:
    """(id, uri, payload) of web pages; a null body is an empty payload, a null address an empty one."""
    col = lambda c: F.col(f"`{c}`")
    return pages.select(col(id_col).cast("long").alias("id"), F.coalesce(col(uri_col).cast("string"), F.lit("")).alias("uri"), F.encode(F.coalesce(col(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))


def _urn(i: Column, uri: Column, digest: Column, copy: Column) -> Column:
    """A record id that follows from what the record is."""
    h = F.md5(F.concat_ws(" ", F.coalesce(i.cast("string"), F.lit("-")), F.hex(digest), copy.cast("string"), uri))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def header(date: str = "1970-01-01T00:00:00Z") -> Column:
    """The bytes of a page's record before its payload: WARC fields and the HTTP header.  The length is that of the block as
    it stands in the record, so a revisit's is that of its HTTP header."""
    revisit = F.col("record_type") == "revisit"
    # no line break of an address may end a field
    clean = lambda uri: F.regexp_replace(uri, "[\\r\\n]+", "%0A")
    lead = F.col("lead")
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", _urn(F.col("id"), F.col("uri"), F.col("digest"), F.col("copy"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.when(F.col("uri") != "", clean(F.col("uri")))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.lower(F.hex("digest")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, _urn(lead["id"], lead["uri"], F.col("digest"), F.lit(1)))),
        ("WARC-Refers-To-Target-URI", F.when(revisit & (lead["uri"] != ""), clean(lead["uri"]))),
        ("WARC-Truncated", F.when(revisit, F.lit("length"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", (F.when(revisit, F.lit(0)).otherwise(F.col("bytes")) + len(HTTP)).cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]  # null where a field is absent
    return F.encode(F.concat(F.concat_ws(BREAK, F.lit(VERSION), *lines), F.lit(BREAK * 2 + HTTP)), "UTF-8")


def write_archive(records: DataFrame, path: str, head: Column | None = None, tail: Column | None = None, least: int = 100, address: Callable[[Column], Column] = sha256) -> None:
    """Writes ``records`` (id, uri, payload, and whatever ``head`` reads) as an archive under ``path``.

    ``head``: the exact bytes before a record's payload; ``header()`` by default, which may use the decisions ``record_type``,
    ``lead`` (id and uri of the record referred to), ``bytes``, ``digest`` and ``copy``; ``tail``: the exact bytes after it.  Of records with equal payloads of
    ``least`` bytes or more, that of the smallest (id, uri), null first, is a response and the others are revisits; of rows
    that repeat wholly, one.  Shorter payloads are stored once too, but all their records are responses.  An empty table
    gives an archive without records.  Two payloads of one address raise ValueError (no headers are written then).
    """
    extra = [c for c in records.columns if c not in ("id", "uri", "payload")]
    rows = records.withColumn("digest", address(F.col("payload")))
    size = F.length("payload").cast("long").alias("bytes")
    heads = materialise(rows.groupBy("id", "uri", *extra, "digest", size).agg(F.count("*").alias("n")), "heads")
    lead = F.min(F.struct("id", "uri")).alias("lead")
    shared = materialise(heads.groupBy("digest").agg(lead, F.sum("n").alias("n")).where("n > 1"), "shared")

    # the store: payloads of one record as they are read, of the others those of their first record
    alone = rows.join(shared, "digest", "left_anti").select("digest", F.lit(1).cast("long").alias("n"), "payload")
    again = rows.join(shared, "digest")
    is_lead = F.col("id").eqNullSafe(F.col("lead.id")) & F.col("uri").eqNullSafe(F.col("lead.uri"))
    first = again.where(is_lead).groupBy("digest").agg(F.first("n").alias("n"), F.min("payload").alias("payload"))
    alone.unionByName(first).write.option("compression", "zstd").parquet(f"{path}/payloads")

    stored = _dealt(records.sparkSession.read.parquet(f"{path}/payloads").where("n > 1")).withColumnRenamed("payload", "kept")
    compared = again.withColumn("slot", _slot(F.col("n"), F.xxhash64("id", "uri"))).join(stored.drop("n"), ["digest", "slot"])
    if unlike := compared.where(F.col("payload") != F.col("kept")).select("digest").first():
        raise ValueError(f"different payloads have the address {bytes(unlike.digest).hex()}")

    told = heads.withColumnRenamed("n", "rows").join(shared.withColumnRenamed("n", "of"), "digest", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    revisit = (F.col("bytes") >= least) & F.col("of").isNotNull() & ~(is_lead & (F.col("copy") == 1))
    told = told.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    told = told.select("id", "uri", "digest", "bytes", "record_type", F.when(revisit, F.col("lead.id")).alias("refers_to"), _slot(F.coalesce("of", F.lit(1).cast("long")), F.xxhash64("id", "uri", "copy")).alias("slot"), (header() if head is None else head).alias("head"), (F.lit(END) if tail is None else tail).alias("tail"))
    told.write.option("compression", "zstd").parquet(f"{path}/headers")
    discard(heads, shared)


def _slots(n: Column) -> Column:
    return F.ceil(n / SLOT).cast("long")


def _slot(n: Column, h: Column) -> Column:
    return F.pmod(h, _slots(n))


def _dealt(payloads: DataFrame) -> DataFrame:
    """Each payload as often as its records need slots."""
    return payloads.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), _slots(F.col("n")) - 1)))


def read_archive(spark: SparkSession, path: str, address: Callable[[Column], Column] = sha256) -> DataFrame:
    """(id, uri, head, payload, tail, digest, record_type, refers_to, intact) of each record under ``path``.

    ``payload`` is the full one, of revisits too; ``intact``: it was found, and has the address and length it was stored
    under.  ``original_record`` puts the bytes of a record together.
    """
    heads, stored = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    rows = heads.join(_dealt(stored).drop("n"), ["digest", "slot"], "left")
    intact = F.coalesce((address(F.col("payload")) == F.col("digest")) & (F.length("payload") == F.col("bytes")), F.lit(False))
    return rows.select("id", "uri", "head", "payload", "tail", "digest", "record_type", "refers_to", intact.alias("intact"))


def original_record(full: bool = False) -> Column:
    """The bytes of a record of ``read_archive``; ``full``: of revisits with their payload too, as they were before."""
    body = F.col("payload") if full else F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return F.concat("head", body, "tail")


def field(name: str) -> Column:
    """A named field of a record's ``head``; null where it is absent."""
    found = F.regexp_extract(F.decode("head", "UTF-8"), rf"(?i)\r\n{re.escape(name)}:[ \t]*([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


_PLACE = re.compile(rb"WARC/\d+\.\d+\r?\n(?:[^\r\n]+\r?\n)*\r?\n")
_LENGTH = re.compile(rb"\r?\ncontent-length:[ \t]*(\d+)", re.IGNORECASE)
_URI = re.compile(rb"\r?\nwarc-target-uri:[ \t]*<?([^\r\n>]*)", re.IGNORECASE)


def split_records(raw: bytes) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """(offset, WARC header, block, what follows) of each record of a file, compressed or not; concatenated, they are the
    file.  What isn't a record ends in ValueError."""
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    at = 0
    while at < len(raw):
        m = _PLACE.match(raw, at)
        size = m and _LENGTH.search(m[0])
        if not size or m.end() + int(size[1]) > len(raw):
            raise ValueError(f"no WARC record at byte {at}")
        end = stop = m.end() + int(size[1])
        while raw[stop : stop + 1] in (b"\r", b"\n"):
            stop += 1
        yield at, m[0], raw[m.end() : end], raw[end:stop]
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(id, uri, payload, before, after, file, error) of the records of WARC files; a file is read by one task, as Spark reads
    binary files.  ``before`` holds the record's header and its HTTP header, ``after`` the line breaks behind it; ``id``
    follows from file and place.  A damaged file gives the records before the damage and a row with its ``error``."""
    bound_batches(spark)
    schema = pa.schema([("id", pa.int64()), ("uri", pa.string()), ("payload", pa.binary()), ("before", pa.binary()), ("after", pa.binary()), ("file", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                try:
                    for at, head, block, after in split_records(raw):
                        cut = block.find(END) + len(END) if block.startswith(b"HTTP/") and END in block else 0
                        i = int.from_bytes(hashlib.sha256(f"{at} {file}".encode()).digest()[:8], "big", signed=True)
                        uri = _URI.search(head)
                        row = {"id": i, "uri": uri[1].decode("utf-8", "replace") if uri else "", "payload": block[cut:], "before": head + block[:cut], "after": after, "file": file, "error": None}
                        yield pa.RecordBatch.from_pylist([row], schema)
                except (ValueError, OSError, EOFError) as e:
                    yield pa.RecordBatch.from_pylist([{"file": file, "error": str(e)}], schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lean(run), "id long, uri string, payload binary, before binary, after binary, file string, error string")
