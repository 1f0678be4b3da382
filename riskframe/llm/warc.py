"""WARC archives with Zstandard, one frame a record (operator 6).

An archive starts with a skippable frame (type 0x184D2A5D) that holds the dictionary; every record after it is a frame
of its own made with that dictionary. The writer trains the dictionary on the first records of the archive, at most
`SAMPLE_BYTES` of them; where they are too few to train on, their bytes themselves are the dictionary. Archives are
written into the shared folder under a name of the attempt and then renamed, so a repeated task does no harm. The reader
gets the dictionary from the leading frame, reads a piece of the file at a time, decodes frame by frame and checks each
record: version line, header syntax, content length, closing line ends, block digest and, of a response, payload digest
and length. A record that fails raises an error that names the archive and the record.

Of records with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is the response, the
others are revisits without payload that refer to it.

Defined results. Null html: an empty payload. Null url: no target header. Line ends in a url are percent-encoded. Rows
with a null page_id, and all rows with the smallest page_id of a payload, are responses. Repeated rows: a record each.
Empty table: no archives, no rows. Other columns are ignored. Of an Arrow batch one payload
at a time becomes a record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SKIPPABLE, TRAINED = 0x184D2A5D, 0xEC30A437
SAMPLE_BYTES, DICT_BYTES, PIECE = 1 << 20, 32 << 10, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    digest = sha1(payload)
    if refers_to is None:
        block += payload
    uri = lambda n: f"<urn:uuid:{uuid.uuid5(NAMES, str(n))}>"
    head = {"WARC-Type": kind, "WARC-Record-ID": uri(page_id), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": uri(refers_to), "X-Refers-To-Page": str(refers_to)}
    if page_id is not None:
        head["X-Page"] = str(page_id)
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "WARC-Block-Digest": f"sha1:{sha1(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def compressors(sample: list[bytes]):
    """The dictionary's bytes and a compressor that uses it."""
    import zstandard as z

    try:
        raw = z.train_dictionary(DICT_BYTES, sample, threads=0).as_bytes() if len(sample) >= 16 else b""
    except z.ZstdError:
        raw = b""
    raw = raw or b"".join(sample)[:DICT_BYTES] or b"WARC/1.1\r\n"
    return raw, z.ZstdCompressor(level=3, dict_data=dictionary(raw), write_content_size=True, write_dict_id=True)


def dictionary(raw: bytes):
    import zstandard as z

    trained = len(raw) >= 8 and struct.unpack("<I", raw[:4])[0] == TRAINED
    return z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_FULLDICT if trained else z.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterator[bytes]) -> int:
    """Write the records to an open binary file; how many there were."""
    sample, size, n = [], 0, 0
    for r in records:
        sample.append(r)
        if (size := size + len(r)) >= SAMPLE_BYTES:
            break
    raw, packer = compressors([r[:8192] for r in sample])
    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
    for part in (sample, records):
        for r in part:
            out.write(packer.compress(r))
            n += 1
    return n


def frames(source) -> Iterator[bytes]:
    """The decoded records of an open archive."""
    import zstandard as z

    head = source.read(8)
    if len(head) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError(f"leading frame is {magic:#x}, not a dictionary")
    raw = source.read(size)
    if len(raw) != size:
        raise ValueError("the dictionary is cut off")
    reader, rest = z.ZstdDecompressor(dict_data=dictionary(raw)), b""
    while rest or (rest := source.read(PIECE)):
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else b""
            if frame.eof:
                break
            if not (rest := source.read(PIECE)):
                raise ValueError("the last frame is cut off")
        yield b"".join(parts)


def parsed(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record, after all checks."""
    head, found, body = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise ValueError(f"no {name}")
    length = int(fields["content-length"])
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise ValueError(f"content length {length}, but {len(body) - 4} bytes")
    block, kind, digest = body[:length], fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if "sha1:" + sha1(block) != fields.get("warc-block-digest", "sha1:" + sha1(block)):
        raise ValueError("the block digest is wrong")
    http, found, payload = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not found or len(sizes) != 1:
        raise ValueError("no length in the HTTP headers")
    if kind == "response" and (len(payload) != sizes[0] or sha1(payload) != digest):
        raise ValueError("the payload's length or digest is wrong")
    if kind == "revisit" and (payload or "x-refers-to-page" not in fields):
        raise ValueError("a revisit with a payload, or that refers to nothing")
    page, refers = fields.get("x-page"), fields.get("x-refers-to-page")
    return int(page) if page else None, sizes[0], digest, kind, int(refers) if refers else None


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, refers_to of pages whose payload a smaller page_id has. Digests are aggregated first, and the join is salted."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    light = pages.filter(F.octet_length(payload) >= least_bytes).select("page_id", F.sha1(payload).alias("sha"))
    first = light.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("most")).filter("most > refers_to").select("sha", "refers_to")
    return common.salted_join(light, first, ["sha"], "page_id").filter("page_id > refers_to").select("page_id", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """One archive a partition; their names (one a task on the driver)."""
    links = revisits(pages, least_bytes).withColumnRenamed("page_id", "_id")
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).join(links, F.col("page_id") == F.col("_id"), "left").drop("_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records():
            for batch in batches:
                columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
                for i in range(batch.num_rows):
                    page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                    yield record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, date)

        task = TaskContext.get()
        some = records()
        if (one := next(some, None)) is None:
            return
        system, top = common.pyarrow_place(folder)
        system.create_dir(top, recursive=True)
        draft, final = f"{top}/.{task.partitionId()}-{task.taskAttemptId()}", f"{top}/{task.partitionId():06d}.warc.zst"

        def rest():
            yield one
            yield from some

        with system.open_output_stream(draft, compression=None) as out:
            n = write_archive(out, rest())
        system.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([final.rpartition("/")[2]]), pa.array([n], pa.int64())], names=["name", "records"])

    return [f"{folder}/{r[0]}" for r in rows.mapInArrow(run, "name string, records long").collect()]


def read(spark, archives: list[str]) -> DataFrame:
    """RECORDS of the archives, one task an archive."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = []
            for uri in batch.column("uri").to_pylist():
                system, path = common.pyarrow_place(uri)
                n = 0
                try:
                    with system.open_input_stream(path, compression=None) as source:
                        for data in frames(source):
                            out.append(parsed(data))
                            n += 1
                except ValueError as e:
                    raise ValueError(f"{uri}, record {n}: {e}") from e
            return dict(zip([c.split()[0] for c in RECORDS.split(", ")], zip(*out, strict=True) if out else [[]] * 5, strict=True))

        return work

    names = spark.createDataFrame([(a,) for a in archives], "uri string").repartition(max(1, len(archives)))
    return common.per_batch(names, make, RECORDS)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    common.prepare(spark)
    return read(spark, write(common.read(spark, sf_dir, "pages"), common.shared_folder(spark)))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least, list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda i: ('0x' || substr(h, 5 * i + 1, 5))::INTEGER) AS parts FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(parts, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32768 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 1024 % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x // 32 % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > least THEN least END AS refers_to
FROM q
"""
