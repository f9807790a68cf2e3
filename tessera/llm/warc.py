"""Dictionary-compressed WARC archives.

Every archive starts with a skippable frame that holds a Zstandard dictionary built from the
archive's own first records; each record follows as a frame of its own, compressed with that
dictionary, so that records can be read at random. Payloads stored once are revisited by later copies.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import possible
from .joins import many_to_one
from .scratch import fresh_path, materialise

#: Fixed values of the format: magic of the dictionary's skippable frame, and of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"

LEVEL = 6
#: The dictionary is trained on so many bytes of an archive's first records.
SAMPLE_BYTES, SAMPLE_EACH, DICTIONARY_BYTES = 1 << 20, 16 << 10, 32 << 10
#: Small archives: the least dictionary, and the least number of samples it is trained on.
LEAST_DICTIONARY, LEAST_SAMPLES = 1 << 10, 8
ARCHIVE_BYTES = 64 << 20
MANIFEST = "path string, records bigint, bytes bigint, dictionary_bytes bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
_URN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _filesystem(uri: str):
    """A file system and path for any URI that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, length: int, refers_to: int | None) -> bytes:
    """A response record of ``payload``, or a revisit of ``refers_to`` where payload is None."""
    block = HTTP_HEAD % length + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_URN, str(page_id))}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_URN, str(refers_to))}>"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of the records, an eighth of their samples' size within bounds.

    Few or small records count several times, beside empty records of the same form (the trainer
    needs some samples and repeats). Where the records can't train one, those empty ones do alone.
    """
    import zstandard

    samples = [r[:SAMPLE_EACH] for r in records if r]
    total = sum(map(len, samples))
    size = min(max(total // 8, LEAST_DICTIONARY), DICTIONARY_BYTES)
    bare = [record_bytes(i, f"http://example.org/{i}", b"", f"{i:032d}", 0, None) for i in range(4 * LEAST_SAMPLES)]
    if len(samples) < LEAST_SAMPLES or total < 8 * LEAST_SAMPLES * LEAST_DICTIONARY:
        samples = samples * LEAST_SAMPLES + bare
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return zstandard.train_dictionary(LEAST_DICTIONARY, bare, k=256, d=8).as_bytes()


class ArchiveWriter:
    """Writes one archive: the first records are held until the dictionary is trained on them."""

    def __init__(self, directory: str, name: str):
        system, root = _filesystem(directory)
        system.create_dir(root, recursive=True)
        self.path = f"{directory}/{name}"
        self.out = system.open_output_stream(f"{root}/{name}", compression=None)  # the name would have it compressed once more
        self.held: list[bytes] | None = []
        self.held_bytes = self.records = self.bytes = self.dictionary_bytes = 0
        self.compressor = None

    def _start(self) -> None:
        import zstandard

        dictionary = train_dictionary(self.held)
        self.dictionary_bytes = len(dictionary)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        held, self.held = self.held, None
        for r in held:
            self._put(self.compressor.compress(r))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.held is None:
            self._put(self.compressor.compress(record))
            return
        self.held.append(record)
        self.held_bytes += min(len(record), SAMPLE_EACH)
        if self.held_bytes >= SAMPLE_BYTES:
            self._start()

    def close(self) -> tuple[str, int, int, int]:
        if self.held is not None:
            self._start()
        self.out.close()
        return self.path, self.records, self.bytes, self.dictionary_bytes


def read_archive(uri: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    system, path = _filesystem(uri)
    with system.open_input_stream(path, compression=None) as stream:
        data = stream.read(8)
        plain = zstandard.ZstdDecompressor()
        if len(data) == 8 and struct.unpack("<II", data)[0] == DICTIONARY_MAGIC:
            dictionary = stream.read(struct.unpack("<II", data)[1])
            if dictionary[:4] == FRAME_MAGIC:
                dictionary = plain.decompress(dictionary)
            plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
            data = b""
        while True:
            data = data or stream.read(chunk)
            if not data:
                return
            frame, parts = plain.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                data = stream.read(chunk)
                if not data:
                    raise EOFError(f"{uri} ends inside a record")
            yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Header fields and block of a record; a response's digest and length are taken from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    out = {
        "page_id": int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None,
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": int(fields["X-Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": kind,
        "refers_to": int(fields["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in fields else None,
        "payload": None,
    }
    if kind == "response":
        out |= {"payload_bytes": len(payload), "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode(), "payload": payload}
    return out


def _write_partition(directory: str, archive_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done, writer = [], None
        context = TaskContext.get()
        stem = f"{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"  # a repeated attempt writes files of its own
        for batch in batches:
            for page_id, url, html, digest, length, refers, first in zip(*(batch.column(c).to_pylist() for c in ("wa_id", "wa_url", "wa_html", "wa_sha1", "wa_bytes", "wa_refers", "wa_first")), strict=True):
                if writer is None:
                    writer = ArchiveWriter(directory, f"{stem}-{len(done):04d}.warc.zst")
                payload = (html or "").encode() if first else None
                writer.add(record_bytes(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), length, refers))
                if writer.bytes >= archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes", "dictionary_bytes"])

    return write


def write_archives(pages: DataFrame, directory: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for every row of ``pages`` below ``directory``; returns the manifest of committed archives.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest page_id
    (null is least; then the largest url) is the response and the others revisit it. Null html is an
    empty payload. Rows equal in all of these: one is the response. Other columns are ignored. Only
    archives named in the manifest count: a lost or repeated task leaves files that nothing reads.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("wa_id"), F.col(url).alias("wa_url"), F.col(html).alias("wa_html"), F.sha1(body.cast("binary")).alias("wa_sha1"), F.octet_length(body).cast("long").alias("wa_bytes"))
    # digests of several rows, each with the row that keeps the payload: one small row per digest
    keys = rows.filter(F.col("wa_bytes") >= min_bytes).select("wa_sha1", F.struct(F.col("wa_id").isNotNull().alias("k"), F.coalesce("wa_id", F.lit(0)).alias("id"), F.coalesce("wa_url", F.lit("")).alias("url")).alias("row"))
    same = keys.groupBy("wa_sha1").agg(F.max("row").alias("wa_keeper"), F.count(F.lit(1)).alias("wa_n")).filter("wa_n > 1")
    # of rows that equal the keeper in every key, only one may hold the payload
    twins = keys.groupBy("wa_sha1", "row").agg(F.count(F.lit(1)).alias("wa_twins")).filter("wa_twins > 1").select("wa_sha1", F.col("row").alias("wa_keeper"), "wa_twins")
    same = materialise(same.join(twins, ["wa_sha1", "wa_keeper"], "left").withColumn("wa_key", F.xxhash64("wa_sha1")), "digests")
    # pages with a payload of their own stay where they are; so do hot payloads' copies. The others meet their keeper by a shuffle
    marked = possible(rows.withColumn("wa_key", F.xxhash64("wa_sha1")), "wa_key", same.select("wa_key")).drop("wa_key")
    near = many_to_one(marked.filter("bf_maybe").drop("bf_maybe"), same.select("wa_sha1", "wa_keeper", "wa_twins", F.col("wa_n").alias("jn_rows")), ["wa_sha1"], "left")
    none = {f.name: F.lit(None).cast(f.dataType) for f in near.schema.fields if f.name in ("wa_keeper", "wa_twins")}
    joined = marked.filter("not bf_maybe").drop("bf_maybe").withColumns(none).unionByName(near)
    own = (F.coalesce("wa_id", F.lit(0)) == F.col("wa_keeper.id")) & (F.col("wa_id").isNotNull() == F.col("wa_keeper.k")) & (F.coalesce("wa_url", F.lit("")) == F.col("wa_keeper.url"))
    single = joined.withColumns({"wa_first": F.col("wa_keeper").isNull() | own, "wa_refers": F.when(F.col("wa_keeper").isNotNull() & ~own & F.col("wa_keeper.k"), F.col("wa_keeper.id"))})
    columns = ["wa_id", "wa_url", "wa_html", "wa_sha1", "wa_bytes", "wa_refers", "wa_first"]
    if same.filter(F.col("wa_twins").isNotNull()).isEmpty():
        out = single.select(*columns)
    else:  # repeated rows: number the twins of a keeper, so that the others revisit it
        from pyspark.sql import Window

        plain = single.filter(F.col("wa_twins").isNull() | ~F.col("wa_first"))
        order = Window.partitionBy("wa_sha1", "wa_part").orderBy("wa_bytes")
        tied = single.filter(F.col("wa_twins").isNotNull() & F.col("wa_first")).drop("wa_html").withColumn("wa_part", F.spark_partition_id())
        tied = materialise(tied.withColumn("wa_rank", F.row_number().over(order)), "twins")
        first = materialise(tied.groupBy("wa_sha1").agg(F.min("wa_part").alias("wa_least"), F.count(F.lit(1)).alias("jn_rows")), "first-twins")
        tied = many_to_one(tied, first, ["wa_sha1"])
        tied = tied.withColumn("wa_first", (F.col("wa_part") == F.col("wa_least")) & (F.col("wa_rank") == 1))
        tied = tied.withColumn("wa_refers", F.when(~F.col("wa_first") & F.col("wa_keeper.k"), F.col("wa_keeper.id")))
        # only the one first row of a payload gets it
        texts = rows.join(same.filter(F.col("wa_twins").isNotNull()).select("wa_sha1"), "wa_sha1", "left_semi").groupBy("wa_sha1").agg(F.max("wa_html").alias("wa_html"))
        tied = tied.filter("wa_first").join(texts, "wa_sha1").select(*columns).unionByName(tied.filter("not wa_first").withColumn("wa_html", F.lit(None).cast("string")).select(*columns))
        out = plain.select(*columns).unionByName(tied.select(*columns))
    out = out.withColumn("wa_html", F.when(F.col("wa_first"), F.col("wa_html")))
    return materialise(out.mapInArrow(_write_partition(directory, archive_bytes), MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in ``manifest``: ids, payload length, digest and bytes, type and reference."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, size = [], 0
                for record in read_archive(path):
                    held.append(parse_record(record))
                    size += len(record)
                    if size >= 4 << 20 or len(held) >= 2000:
                        yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, types, strict=True)], names=names)
                        held, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, types, strict=True)], names=names)

    spark = manifest.sparkSession
    tasks = max(int(spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks, F.xxhash64("path")).mapInArrow(read, RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = write_archives(pages, fresh_path(spark, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HEX = "concat({})".format(", ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(h, {5 * i + 1}, 5)) AS BIGINT) >> {15 - 5 * j}) & 31 AS BIGINT), 1)" for i in range(8) for j in range(4)))
ORACLE = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), w AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS keeper FROM p
)
SELECT page_id, payload_bytes, {_HEX} AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM w
"""
