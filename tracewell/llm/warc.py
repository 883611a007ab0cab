"""WARC archives: writing, reading, and resolving revisits by payload digest."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import delete_path, materialise, new_path, scratch, small

#: Bytes a payload must have to be replaced by a revisit record.
LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"
#: What a read yields; ``payload`` is null where it isn't asked for.
RECORD = "file string, pos long, record_type string, record_id string, uri string, page_id long, refers_to_id string, bytes long, digest string, payload binary"


def _uuid(key: Column) -> Column:
    return F.regexp_replace(F.md5(key), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"<urn:uuid:$1-$2-$3-$4-$5>")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(_EOL)), F.lit(""))


def _record(kind: Column, record_id: Column, uri: Column, page_id: Column, digest: Column, payload: Column, size: Column, refers: Column, refers_uri: Column) -> Column:
    """A record as text, without the two line ends after it; ``payload`` is null for revisits."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "), size.cast("string"), F.lit(_EOL + _EOL))
    block = F.concat(http, F.coalesce(payload, F.lit("")))
    head = F.concat(
        F.lit("WARC/1.1" + _EOL), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", F.regexp_replace(uri, r"[\x00-\x20\x7f]", "%20")), _line("X-Page-Id", page_id.cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)), _line("WARC-Refers-To", refers),
        _line("WARC-Refers-To-Target-URI", F.regexp_replace(refers_uri, r"[\x00-\x20\x7f]", "%20")),
        _line("WARC-Profile", F.when(refers.isNotNull(), F.lit(PROFILE))), F.lit(f"Content-Type: application/http; msgtype=response{_EOL}"),
        _line("Content-Length", F.octet_length(block).cast("string")), F.lit(_EOL),
    )
    return F.concat(head, block)


def _write(records: DataFrame, path: str, compression: str) -> None:
    """One archive per partition. Spark's text sink writes the records' bytes as they are, and the
    line separator is the end that the format asks for; so any store that Spark writes to will do."""
    records.write.option("lineSep", _EOL + _EOL).option("compression", compression).text(path)


def write_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "gzip") -> None:
    """Write a response record for every row of ``pages`` (null html: an empty payload)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    key = F.concat_ws("|", F.monotonically_increasing_id().cast("string"), F.col("page_id").cast("string"), F.col("url"))
    rows = rows.withColumn("rid", _uuid(key))
    none = F.lit(None).cast("string")
    _write(rows.select(_record(F.lit("response"), F.col("rid"), F.col("url"), F.col("page_id"), F.sha2("html", 256), F.col("html"), F.octet_length("html"), none, none).alias("value")), path, compression)


class Reader:
    """Records of one archive, from its bytes; plain or gzip with any number of members."""

    def __init__(self, content: bytes, chunk: int = 1 << 20) -> None:
        self.chunks = self._inflated(content, chunk) if content[:2] == b"\x1f\x8b" else iter([content])
        self.buffer, self.at = b"", 0

    @staticmethod
    def _inflated(content: bytes, chunk: int) -> Iterator[bytes]:
        left = content
        while left[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            at = 0
            while not member.eof and at < len(left):
                yield member.decompress(left[at : at + chunk])
                at += chunk
            if not member.eof:
                raise ValueError("an archive ends inside a gzip member")
            left = member.unused_data + left[at:]

    def _more(self) -> bool:
        nxt = next(self.chunks, None)
        if nxt is None:
            return False
        self.buffer, self.at = self.buffer[self.at :] + nxt, 0
        return True

    def _until(self, mark: bytes) -> bytes | None:
        while (end := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.buffer[self.at : end], end + len(mark)
        return out

    def _take(self, n: int) -> bytes:
        parts, have = [], 0
        while have < n:
            got = self.buffer[self.at : self.at + n - have]
            parts.append(got)
            have += len(got)
            self.at += len(got)
            if have < n and not self._more():
                raise ValueError("an archive ends inside a record")
        return b"".join(parts)

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """(header fields in lower case, block) of each record; lengths, not content, delimit them."""
        while (head := self._until(b"\r\n\r\n")) is not None:
            lines = head.lstrip(b"\r\n").split(b"\r\n")
            if not lines[0].startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            fields = {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
            block = self._take(int(fields["content-length"]))
            if self._take(4) != b"\r\n\r\n":
                raise ValueError("a record doesn't end where its length says")
            yield fields, block


def _parse(with_payload: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string())) for n, x in zip(names, RECORD.split(", "), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for pos, (f, block) in enumerate(Reader(content.as_py())):
                    _, _, payload = block.partition(b"\r\n\r\n")
                    revisit = f.get("warc-type") == "revisit"
                    digest = f.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    page = f.get("x-page-id")
                    rows.append((path.as_py(), pos, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), int(page) if page else None, f.get("warc-refers-to"), None if revisit else len(payload), digest, payload if with_payload else None))
                    held += 200 + with_payload * len(payload)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under ``path``. ``bytes`` and ``digest`` come from the payload itself; a revisit
    has the digest that its header names and no bytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_parse(with_payload), RECORD)


def deduplicate(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Write the archives under ``source`` again to ``target``, repeated payloads as revisit records.

    Headers alone are shuffled by digest; the record with the smallest page id (null last, then
    place in the archives) of each digest stays a response. Payloads are then joined with the
    revisits alone, which Spark broadcasts if their written table is small. All records get fresh
    headers and ids.
    """
    heads = materialise(read_archives(spark, source, with_payload=False).drop("payload"), "warc-heads")
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "file", "pos", "record_id", "uri")).alias("o")
    repeated = materialise(heads.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.count("*").alias("c"), first).where("c > 1").select("digest", "o"), "warc-repeated")
    revisits = heads.join(small(repeated), "digest").where("not (file = o.file and pos = o.pos)").where(F.col("record_type") == "response")
    revisits = materialise(revisits.select("file", "pos", F.col("o.record_id").alias("o_id"), F.col("o.uri").alias("o_uri")), "warc-revisits")
    records = read_archives(spark, source).join(small(revisits), ["file", "pos"], "left")
    again = F.col("o_id").isNotNull()
    fresh = lambda c: _uuid(F.concat(F.lit("again|"), c))
    text = F.col("payload").cast("string")
    _write(records.select(_record(F.when(again, "revisit").otherwise("response"), fresh(F.col("record_id")), F.col("uri"), F.col("page_id"), F.col("digest"), F.when(~again, text), F.col("bytes"), fresh(F.col("o_id")), F.col("o_uri")).alias("value")), target, compression)


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """What the archives under ``path`` say of each page, revisits joined with their responses.

    Result: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to``.
    """
    heads = materialise(read_archives(spark, path, with_payload=False).drop("payload"), "warc-resolved")
    shape = ["page_id", F.col("uri").alias("url"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type"]
    responses = heads.where("record_type = 'response'").select(*shape, F.lit(None).cast("long").alias("refers_to"))
    originals = heads.where("record_type = 'response'").select(F.col("record_id").alias("o_id"), F.col("page_id").alias("o_page"), F.col("bytes").alias("o_bytes"), F.col("digest").alias("o_digest"))
    revisits = heads.where("record_type = 'revisit'").join(originals, F.col("refers_to_id") == F.col("o_id"), "left")
    found = revisits.select("page_id", F.col("uri").alias("url"), F.col("o_bytes").alias("payload_bytes"), F.col("o_digest").alias("payload_digest"), "record_type", F.col("o_page").alias("refers_to"))
    return responses.unionByName(found)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives, deduplicate them and read the result back, one row per page.

    Null html is an empty payload; a null url leaves its header out, a null page id too (such a row
    comes back with a null id). Rows that repeat are records of their own. Payloads of less than
    ``LEAST_BYTES`` bytes are responses always. An empty table gives an empty result. Both sets of
    archives are removed once they have been read.
    """
    spark = pages.sparkSession
    raw, out = new_path(spark, "warc-raw"), new_path(spark, "warc-dedup")
    with scratch(spark) as block:
        write_pages(pages, raw, id_col, url_col, html_col)
        deduplicate(spark, raw, out)
        delete_path(spark, raw)
        found = block.keep(resolve(spark, out), "warc-pages")
    delete_path(spark, out)
    return found


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), b AS (
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM b
"""
