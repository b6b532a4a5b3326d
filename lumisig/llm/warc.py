"""WARC archives without repeated payloads.

Headers are shuffled by payload digest; of each set of equal payloads one record
stays a response and the others become revisits that refer to it. Records are
written with fresh headers by Spark's own text writer, whose line separator is
the end of a WARC record, so that any shared file system and the usual commit of
finished tasks serve; archives are read back as whole files, record by record.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, sized_broadcast

CRLF = "\r\n"
#: Fixed by the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _payload(html_col: str) -> Column:
    return F.coalesce(F.col(html_col).cast("string"), F.lit(""))


def headers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, payload_digest, payload_bytes): lower-case hex SHA-1 and length of the UTF-8 payload; null is empty."""
    p = _payload(html_col)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha1(p.cast("binary")).alias("payload_digest"), F.octet_length(p).cast("long").alias("payload_bytes"))


def revisits(heads: DataFrame, min_bytes: int = 1000, salts: int = 32) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that repeat a payload of ``min_bytes`` or more.

    The response is the record with the largest id. Ids are combined by digest before the
    shuffle, and the copies of a payload are dealt over ``salts`` tasks to meet it. Records
    with a null id are responses.
    """
    large = heads.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
    kept = (
        large.groupBy("payload_digest")
        .agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
        .where("least < refers_to")
        .select("payload_digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    dealt = large.select("page_id", "payload_digest", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int").alias("salt"))
    return dealt.join(kept, ["payload_digest", "salt"]).where("page_id < refers_to").select("page_id", "payload_digest", "refers_to").distinct()


def _urn(id_col: str) -> Column:
    """A record's id, made from its page's id."""
    h = F.lower(F.lpad(F.hex(F.col(id_col)), 32, "0"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame, again: DataFrame, date: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(value): each page's WARC record, without the two line ends that close it."""
    p = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.sha1(_payload(html_col).cast("binary")).alias("payload_digest"), _payload(html_col).alias("payload"),
        F.replace(F.replace(F.col(url_col).cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
    )
    p = p.join(sized_broadcast(again), ["page_id", "payload_digest"], "left")
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(CRLF * 2))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
        _line("WARC-Record-ID", F.coalesce(_urn("page_id"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        _line("WARC-Date", when), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Refers-To", _urn("refers_to")), _line("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        _line("Source-Row", F.col("page_id").cast("string")), _line("Source-Row-Referred", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF), _line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF),
    )
    return p.select(F.concat(head, block).alias("value"))


#: Payloads up to this size are written ``per_file`` to an archive; of larger ones fewer, by powers of two.
USUAL_BYTES = 1 << 16


def write_archives(pages: DataFrame, path: str, min_bytes: int = 1000, per_file: int = 2000, **names: str) -> None:
    """Write ``pages`` as gzipped archives of at most ``per_file`` records in the new folder ``path``.

    Pages are written by classes of payload size, each of which has half the records in a file of the one before, so that no
    archive holds more than some ``per_file * USUAL_BYTES``, or one record: readers take archives whole.
    """
    heads = headers(pages, **{k: v for k, v in names.items() if k != "url_col"})
    again = materialize(revisits(heads, min_bytes))
    size = lambda n: F.greatest(F.lit(0), F.ceil(F.log2(n / F.lit(USUAL_BYTES)))).cast("int")
    sizes = sorted(r[0] for r in heads.select(size(F.greatest("payload_bytes", F.lit(1)))).distinct().collect())  # under twenty
    for k in sizes or [0]:
        n = F.greatest(F.octet_length(_payload(names.get("html_col", "html"))), F.lit(1))
        some = pages.where(size(n) == k) if len(sizes) > 1 else pages
        records(some, again, **names).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file >> k)).text(f"{path}/size-{k}")


def parse(content: bytes, step: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, gzipped or not, without holding it whole unzipped."""
    zipped = content[:2] == b"\x1f\x8b"
    buffer, view, at = bytearray(), memoryview(content), 0
    unzip = zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, unzip
        if at >= len(view):
            return False
        part = bytes(view[at : at + step])
        at += len(part)
        while zipped and part:
            buffer.extend(unzip.decompress(part))
            part = unzip.unused_data
            if unzip.eof:
                unzip = zlib.decompressobj(31)
        buffer.extend(part)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends within a header")
                return
        head = bytes(buffer[:end]).decode()
        if not head.startswith("WARC/1."):
            raise ValueError(f"no WARC record: {head[:40]!r}")
        fields = dict(re.findall(r"\r\n([^:\r\n]+): ?([^\r\n]*)", head))
        n = end + 4 + int(fields["Content-Length"])
        while len(buffer) < n + 4:
            if not more():
                raise ValueError("an archive ends within a record")
        yield fields, bytes(buffer[end + 4 : n])
        del buffer[: n + 4]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path`` (see RECORD).

    A response's payload, digest and length are those of its block; its digest must be that of
    its header. A revisit's are those that it states of the payload it refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                cols: list[list] = [[] for _ in range(7)]
                size = 0
                for f, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    stated = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if f["WARC-Type"] == "response":
                        n, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if digest != stated:
                            raise ValueError(f"payload of {f['WARC-Record-ID']} does not have the digest that it states")
                    else:
                        n, digest, payload = int(re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)[1]), stated, None
                    ids = [int(f[k]) if k in f else None for k in ("Source-Row", "Source-Row-Referred")]
                    for c, x in zip(cols, (f["WARC-Type"], ids[0], f.get("WARC-Target-URI"), ids[1], digest, n, payload), strict=True):
                        c.append(x)
                    size += len(block)
                    if size > 8 << 20:
                        yield _batch(cols)
                        cols, size = [[] for _ in range(7)], 0
                if cols[0]:
                    yield _batch(cols)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, RECORD)


def _batch(cols: list[list]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["record_type", "page_id", "url", "refers_to", "payload_digest", "payload_bytes", "payload"])


def restore(found: DataFrame) -> DataFrame:
    """``found`` (records as read) with each revisit given the payload of the response that it refers to."""
    first = found.where("record_type = 'response'").select(F.col("page_id").alias("__to"), F.col("payload_digest").alias("__digest"), F.col("payload").alias("__payload")).dropDuplicates(["__to", "__digest"])
    same = (F.col("refers_to") == F.col("__to")) & (F.col("payload_digest") == F.col("__digest"))
    return found.join(first, same, "left").withColumn("payload", F.coalesce("payload", "__payload")).drop("__to", "__digest", "__payload")
