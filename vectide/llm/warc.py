"""WARC archives: whole-file gzip streams are inflated once and rewritten, one gzip member per record, with an index."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import Scratch, small_batches, table

#: Uncompressed bytes after which an archive is closed.
ARCHIVE_BYTES = 32 << 20
#: Bytes read or inflated at a time.
STEP = 1 << 18
#: Copies of the key of a payload that many rows share.
SALTS = 16

_ESCAPES = {c: f"%{c:02X}" for c in [*range(0x21), 0x7F]}


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit names the digest and length of the payload and leaves the payload out."""
    sha = digest(payload)
    uri = (url or "urn:none").translate(_ESCAPES)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{uri}|{sha}|{refers_to}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{own}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, in steps."""
    unzip = zlib.decompressobj(31)
    while step := source.read(STEP):
        while step:
            if out := unzip.decompress(step, STEP):
                yield out
            if unzip.eof:
                step, unzip = unzip.unused_data, zlib.decompressobj(31)
            else:
                step = unzip.unconsumed_tail
    if out := unzip.flush():
        yield out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, whole record) of an inflated stream; one record is held at a time."""
    held = bytearray()
    steps = _inflated(source)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(steps, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("the archive ends inside a record header")
                return
        lines = bytes(held[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record at this place")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = end + 4 + int(fields["content-length"]) + 4
        if not fill(size):
            raise ValueError("the archive ends inside a record")
        whole = bytes(held[:size])
        del held[:size]
        yield fields, whole


def normalise(source, archive, index) -> tuple[int, int]:
    """Rewrite a gzip stream as one member per record, with an index line (offset, length, id, type) for each.

    The stream is inflated once. Returns records and bytes written.
    """
    at = n = 0
    for fields, whole in records(source):
        zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = zipped.compress(whole) + zipped.flush()
        archive.write(member)
        line = {"offset": at, "length": len(member), "id": fields.get("warc-record-id"), "type": fields.get("warc-type")}
        index.write(json.dumps(line).encode() + b"\n")
        at += len(member)
        n += 1
    return n, at


def parse(member: bytes) -> dict:
    """The fields of one member, its payload (None for a revisit) and the digest found in the bytes."""
    import io

    [(fields, whole)] = records(io.BytesIO(member))
    start = whole.index(b"\r\n\r\n") + 4
    body = whole[start : start + int(fields["content-length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    kind = fields["warc-type"]
    named = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and digest(payload) != named:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("x-page-id"),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": len(payload) if kind == "response" else int(fields["x-payload-length"]),
        "payload_digest": named,
        "record_type": kind,
        "refers_to": number("x-refers-to-page-id"),
        "payload": payload if kind == "response" else None,
    }


MANIFEST = "archive string, index string, records long, bytes long"


def write_archives(
    pages: DataFrame,
    out_dir: str,
    scratch: Scratch,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per row and return the manifest (archive, index, records, bytes).

    Of the rows whose payloads are equal and at least ``min_bytes`` long, the one of the smallest id is a response
    and the others revisit it. A null html is the empty payload. Rows that repeat the smallest id are responses too.
    A null id revisits a payload that a row with an id holds, else it is a response without an id. Each task writes
    a monolithic gzip stream of bounded size, then normalises it. File names come from the partition, and files
    appear whole, so a task that is run again replaces its own output.
    """
    spark = pages.sparkSession
    small_batches(spark)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("__sha")
    )
    slim = rows.filter(F.octet_length("html") >= min_bytes).select("page_id", "__sha")
    shared = slim.groupBy("__sha").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).filter("__n > 1 and __first is not null")
    # a payload that many rows share is dealt over SALTS keys
    salted = shared.select(F.col("__sha").alias("__s"), "__first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    own = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    again = scratch.keep(
        slim.distinct()
        .join(salted, (F.col("__sha") == F.col("__s")) & (own == F.col("__salt")))
        .filter(~F.col("page_id").eqNullSafe(F.col("__first")))
        .select(F.col("page_id").alias("__id"), "__s", "__first"),
        "revisits",
    )
    marked = rows.join(
        again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__s")), "left"
    ).select("page_id", "url", "html", F.col("__first").alias("refers_to"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows():
            for b in batches:
                for i in range(b.num_rows):
                    yield [b.column(k)[i].as_py() for k in range(4)]

        source, k, out = rows(), 0, []
        row = next(source, None)
        while row is not None:
            stem = f"{out_dir}/part-{part:05d}-{k:04d}"
            total, zipped = 0, zlib.compressobj(1, zlib.DEFLATED, 31)
            with files.writing(f"{stem}.whole.gz") as f:
                while row is not None and total < archive_bytes:
                    page, url, text, first = row
                    raw = record(page, url, text.encode("utf-8", "surrogatepass"), first, first is not None)
                    f.write(zipped.compress(raw))
                    total += len(raw)
                    row = next(source, None)
                f.write(zipped.flush())
            with files.reading(f"{stem}.whole.gz") as f, files.writing(f"{stem}.warc.gz") as a, files.writing(f"{stem}.index.jsonl") as x:
                n, size = normalise(f, a, x)
            files.delete(f"{stem}.whole.gz")
            out.append((f"{stem}.warc.gz", f"{stem}.index.jsonl", n, size))
            k += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))],
            ["archive", "index", "records", "bytes"],
        )

    return scratch.keep(marked.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives, read member by member at the offsets of the sidecar index."""
    fields = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def read(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[f] for r in rows], t) for f, t in zip(fields, types, strict=True)], fields)

        for b in batches:
            for archive, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                with files.reading(index) as x, files.reading(archive) as a:
                    for line in x:
                        at = json.loads(line)
                        a.seek(at["offset"])
                        rows.append(parse(a.read(at["length"])))
                        held += len(rows[-1]["payload"] or b"") if payloads else 0
                        if not payloads:
                            rows[-1]["payload"] = None
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    parts = max(1, manifest.count())
    return manifest.select("archive", "index").repartition(parts).mapInArrow(read, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = write_archives(table(spark, sf_dir, "pages"), scratch.path("archives"), scratch)
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
