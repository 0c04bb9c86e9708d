"""WARC archives of web pages in Zstandard: a writer with revisit records, and a reader.

An archive starts with a skippable frame that holds the compression dictionary; every record is one frame after it, so that
records can be read on their own. The reader loads the dictionary, walks from frame to frame by the block headers, decodes
each frame and validates header lines, lengths and digests; what fails raises ValueError with the place.

Archives travel as rows of a Spark table (archive number, content): Spark's writers and commit protocol put them in any
store, tasks can be repeated, and an archive's size is bounded by `archive_bytes` and one record. `export` writes them as
.warc.zst files and `read_files` reads such files.

Defined results: a null text is an empty payload, always a response if payloads that small are not revisited; rows that
share the smallest id of their payload are all responses; a null id is kept and refers to or is referred to only as null;
a null url is written as an opaque URN; other columns are ignored; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ARCHIVE_SCHEMA = "archive string, content binary"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _urn(page_id: int | None, mark: str = "") -> str:
    return f"<urn:x-page:{mark or 'id'}:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response, or a revisit whose block has the HTTP header only; `length` and `digest` are of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {date}"]
    lines.append("WARC-Target-URI: " + ("urn:x-unknown" if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = 16 << 10) -> bytes:
    """A compression dictionary; empty where there are too few samples to make one of."""
    import zstandard

    samples = [x for x in samples if x]
    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Collects records, one frame each, behind the dictionary's skippable frame."""

    def __init__(self, shared: bytes, level: int = 3):
        import zstandard

        known = zstandard.ZstdCompressionDict(shared) if shared else None
        self._compress = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True, write_content_size=True).compress
        self.content = bytearray(struct.pack("<II", SKIPPABLE, len(shared)) + shared)
        self.records = 0

    def add(self, raw: bytes) -> None:
        self.content += self._compress(raw)
        self.records += 1


def frame_end(content: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, by its header and block headers."""
    if len(content) - at < 6 or struct.unpack_from("<I", content, at)[0] != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = content[at + 4]
    single, size_flag, checksum = flags >> 5 & 1, flags >> 6, flags >> 2 & 1
    place = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((single, 2, 4, 8)[size_flag])
    last = False
    while not last:
        if place + 3 > len(content):
            raise ValueError(f"the frame at byte {at} is cut off")
        head = int.from_bytes(content[place : place + 3], "little")
        last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError(f"the frame at byte {at} has a reserved block type")
        place += 3 + (1 if kind == 1 else size)
    place += 4 * checksum
    if place > len(content):
        raise ValueError(f"the frame at byte {at} is cut off")
    return place


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, decoded bytes) of every record frame of an archive."""
    import zstandard

    view = memoryview(content)
    if len(view) < 8 or struct.unpack_from("<I", view)[0] != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    size = struct.unpack_from("<I", view, 4)[0]
    if 8 + size > len(view):
        raise ValueError("the dictionary frame is cut off")
    shared = bytes(view[8 : 8 + size])
    if shared[:4] == struct.pack("<I", FRAME):  # dictionaries may be compressed themselves
        shared = zstandard.ZstdDecompressor().decompress(shared)
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared) if shared else None)
    at = 8 + size
    while at < len(view):
        end = frame_end(view, at)
        try:
            raw = decode.decompress(view[at:end])
        except zstandard.ZstdError:
            try:
                raw = decode.decompressobj().decompress(bytes(view[at:end]))  # frames of other writers may lack their size
            except zstandard.ZstdError as error:
                raise ValueError(f"the frame at byte {at} can't be decoded: {error}") from error
        yield at, raw
        at = end


def parse(raw: bytes, at: int = 0) -> dict:
    """Header fields and block of one record, validated."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record at byte {at}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line {line!r} at byte {at}")
        fields[name.strip().lower()] = value.strip()
    for name in NEEDED:
        if name.lower() not in fields:
            raise ValueError(f"the record at byte {at} has no {name}")
    length = fields["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError(f"the record at byte {at} is not as long as it says")
    block = rest[:-4]
    _digest_holds(fields.get("warc-block-digest"), block, f"block at byte {at}")
    return fields | {"": block}


def _digest_holds(said: str | None, data: bytes, what: str) -> None:
    if said and said.startswith("sha256:") and hashlib.sha256(data).hexdigest() != said[7:]:
        raise ValueError(f"the digest of the {what} doesn't hold")


def page_of(fields: dict, at: int = 0) -> tuple:
    """The row of RECORD_SCHEMA for a parsed record: lengths and digests are of the full payload, for revisits too."""
    kind, block = fields["warc-type"], fields[""]
    http, found, payload = block.partition(b"\r\n\r\n")
    lengths = [int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not found or len(lengths) != 1:
        raise ValueError(f"the HTTP header at byte {at} has no length")
    digest = fields.get("warc-payload-digest", "")
    if kind == "response":
        if len(payload) != lengths[0]:
            raise ValueError(f"the payload at byte {at} is not as long as its header says")
        _digest_holds(digest, payload, f"payload at byte {at}")
    elif kind != "revisit" or payload or "warc-refers-to" not in fields:
        raise ValueError(f"the record at byte {at} is neither a response nor a revisit")
    refers = _page_of(fields["warc-refers-to"]) if kind == "revisit" else None
    return _page_of(fields["warc-record-id"]), lengths[0], digest.removeprefix("sha256:"), kind, refers, fields.get("warc-target-uri"), payload if kind == "response" else None


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_revisit: int = 100, archive_bytes: int = 16 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z", sample: int = 200) -> None:
    """Write archives of all pages to the table at `path`.

    The dictionary is made of the beginnings of `sample` pages at most, those with the least hashes; it bears on size only, never on
    what is stored.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), html.alias("payload"))
    heads = rows.select("id", F.substring("payload", 1, 8192).alias("payload"))
    shared = dictionary([bytes(r.payload) for r in heads.orderBy(F.xxhash64("id", "payload"), "payload").limit(sample).collect()])

    keyed = rows.withColumns({"digest": F.sha2("payload", 256), "length": F.octet_length("payload").cast("long")})
    firsts = keyed.select("id", "digest", "length").filter(F.col("length") >= least_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    typed = keyed.join(firsts, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    records = typed.select("id", "url", F.when(~F.col("revisit"), F.col("payload")).alias("payload"), "length", "digest", F.when(F.col("revisit"), F.col("first")).alias("first"), "revisit")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, first = ArchiveWriter(shared, level), ""

        def done() -> pa.RecordBatch:
            content = bytes(writer.content)
            name = hashlib.sha256(content).hexdigest()[:32]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(batch.num_columns)), strict=True):
                page_id, url, payload, length, digest, first, revisit = (x.as_py() for x in row)
                writer.add(record(page_id, url, payload, length, digest, first, revisit, date))
                if len(writer.content) >= archive_bytes:
                    yield done()
                    writer = ArchiveWriter(shared, level)
        if writer.records:
            yield done()

    records.mapInArrow(pack, ARCHIVE_SCHEMA).write.mode("overwrite").option("compression", "none").parquet(path)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (column content) as rows of RECORD_SCHEMA; without `payloads` the payload is null."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for at, raw in frames(content.as_py()):
                    row = page_of(parse(raw, at), at)
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(raw) if payloads else 200
                    if size > 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("content").mapInArrow(unpack, RECORD_SCHEMA)


def read_files(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of .warc.zst files."""
    return read(spark.read.format("binaryFile").load(path), payloads)


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write archives as .warc.zst files to a folder of any file system that Spark knows, one at a time; returns their paths."""
    spark, paths = archives.sparkSession, []
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for row in archives.toLocalIterator():
        where = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row.archive}.warc.zst")
        out = where.getFileSystem(conf).create(where, True)
        try:
            out.write(bytearray(row.content))
        finally:
            out.close()
        paths.append(f"{folder}/{row.archive}.warc.zst")
    return paths
