"""What ORC files say about themselves, as small tables: layout, types, stripes, streams, encodings and statistics.

Tails, stripe footers and row indexes are read through the Hadoop file system that Spark uses, by `threads` threads of the
driver, which owns the JVM's reader; rows go to the shared folder every `CHUNK` files, so that the driver holds no more however
many files there are. A row index takes the driver a few calls for each stripe and column: it passes the bytes on, and the executors
make rows of their entries. What needs the files' contents (the framing of compressed blocks) is read by the executors.
"""

from __future__ import annotations

import datetime
import struct
import uuid
from collections.abc import Callable, Collection, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stripewise.storage import shared_folder

STATISTICS_SCHEMA = (
    "file string, stripe int, row_group int, column_id int, num_present bigint, has_null boolean, int_min bigint, int_max bigint, int_sum bigint, "
    "double_min double, double_max double, double_sum double, string_min string, string_max string, total_length bigint, true_count bigint, "
    "date_min date, date_max date, millis_min bigint, millis_max bigint, decimal_min string, decimal_max string, decimal_sum string"
)
_MEASURES = tuple(part.split()[0] for part in STATISTICS_SCHEMA.split(", ")[6:])
CHUNK = 2000
#: The same where row indexes are read.
INDEX_CHUNK = 200
THREADS = 16


def _files(spark: SparkSession, path: str) -> Iterator[str]:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(conf).listFiles(root, True)
    while listed.hasNext():
        name = listed.next().getPath()
        if not name.getName().startswith(("_", ".")):
            yield name.toString()


def _reader(spark: SparkSession, name: str):
    orc, conf = spark._jvm.org.apache.orc.OrcFile, spark._jsc.hadoopConfiguration()
    return orc.createReader(spark._jvm.org.apache.hadoop.fs.Path(name), orc.readerOptions(conf))


def _table(spark: SparkSession, path: str, rows_of: Callable, schema: str, chunk: int | None = None, threads: int = THREADS) -> DataFrame:
    """rows_of(file name, reader) of every file below the path."""
    names, target = _files(spark, path), None
    with ThreadPoolExecutor(threads) as pool:
        while some := list(islice(names, chunk or CHUNK)):
            rows = [row for part in pool.map(lambda name: rows_of(name, _reader(spark, name)), some) for row in part]
            df = spark.createDataFrame(rows, schema)
            if target is None and len(some) < (chunk or CHUNK):
                return df
            target = target or f"{shared_folder(spark)}/orc-tails-{uuid.uuid4().hex}"
            df.write.mode("append").parquet(target)
    return spark.read.schema(df.schema).parquet(target) if target else spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, rows, stripes, codec, block_size, row_index_stride, content_length, writer_version and schema of each file."""

    def rows(name: str, r) -> list[tuple]:
        return [(name, r.getNumberOfRows(), r.getStripes().size(), r.getCompressionKind().toString().lower(), r.getCompressionSize(), r.getRowIndexStride(), r.getContentLength(), r.getWriterVersion().toString(), r.getSchema().toString())]

    return _table(spark, path, rows, "file string, rows bigint, stripes int, codec string, block_size int, row_index_stride int, content_length bigint, writer_version string, schema string", **options)


def stripes(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, stripe, offset, index_length, data_length, footer_length and rows of each stripe."""

    def rows(name: str, r) -> list[tuple]:
        return [(name, k, s.getOffset(), s.getIndexLength(), s.getDataLength(), s.getFooterLength(), s.getNumberOfRows()) for k, s in enumerate(r.getStripes())]

    return _table(spark, path, rows, "file string, stripe int, offset bigint, index_length bigint, data_length bigint, footer_length bigint, rows bigint", **options)


def types(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, column_id, kind, children and field_names of each file's type tree, in pre-order."""

    def rows(name: str, r) -> list[tuple]:
        found, waiting = [], [r.getSchema()]
        while waiting:
            node = waiting.pop(0)
            children = list(node.getChildren() or [])
            names = list(node.getFieldNames() or []) if node.getCategory().getName() == "struct" else []
            found.append((name, node.getId(), node.getCategory().getName(), [c.getId() for c in children], names))
            waiting = children + waiting
        return found

    return _table(spark, path, rows, "file string, column_id int, kind string, children array<int>, field_names array<string>", **options)


def _footers(r) -> Iterator[tuple[int, object, object]]:
    """Number, description and footer of each stripe."""
    records = r.rows()
    try:
        for k, stripe in enumerate(r.getStripes()):
            yield k, stripe, records.readStripeFooter(stripe)
    finally:
        records.close()


def streams(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, stripe, place, column_id, kind, area (index or data), offset and length of each stream, in the order they are stored."""

    def rows(name: str, r) -> list[tuple]:
        found = []
        for k, stripe, footer in _footers(r):
            at = stripe.getOffset()
            for place, s in enumerate(footer.getStreamsList()):
                kind = s.getKind().toString().lower()
                area = "index" if kind.startswith(("row_index", "bloom_filter")) else "data"
                found.append((name, k, place, s.getColumn(), kind, area, at, s.getLength()))
                at += s.getLength()
        return found

    return _table(spark, path, rows, "file string, stripe int, place int, column_id int, kind string, area string, offset bigint, length bigint", **options)


def encodings(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, stripe, column_id, encoding and dictionary_size of every column in each stripe."""

    def rows(name: str, r) -> list[tuple]:
        return [(name, k, column, e.getKind().toString().lower(), e.getDictionarySize() if e.hasDictionarySize() else None) for k, _, footer in _footers(r) for column, e in enumerate(footer.getColumnsList())]

    return _table(spark, path, rows, "file string, stripe int, column_id int, encoding string, dictionary_size bigint", **options)


def positions(spark: SparkSession, path: str, columns: Collection[int] | None = None, **options) -> DataFrame:
    """file, stripe, row_group, column_id and positions (where its streams are to be sought) of every row index entry; only the given columns' indexes are read."""

    def rows(entry: bytes) -> list:
        return [[at for number, value in _fields(entry) if number == 1 for at in ([value] if isinstance(value, int) else _varints(value))]]

    return _entries(spark, path, columns, rows, "file string, stripe int, row_group int, column_id int, positions array<bigint>", **options)


def column_sizes(spark: SparkSession, path: str, **options) -> DataFrame:
    """column_id, streams, index_length and data_length in bytes as stored, over all files: what fills the stripes."""
    said = streams(spark, path, **options)
    sizes = {f"{area}_length": F.coalesce(F.sum(F.when(F.col("area") == area, F.col("length"))), F.lit(0)) for area in ("index", "data")}
    return said.groupBy("column_id").agg(F.count("*").alias("streams"), *(x.alias(name) for name, x in sizes.items()))


def blocks(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, stripe, column_id, kind, blocks, stored_as_is (blocks that don't shrink), header_bytes and payload_bytes of compressed streams.

    Read from the files' contents, by the executors; a file must fit a binary cell (2 GB).
    """
    wanted = streams(spark, path, **options).join(files(spark, path, **options).filter("codec <> 'none'").select("file"), "file").filter("length > 0")
    name = F.regexp_replace("path", "^file:/+", "/")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(name.alias("name"), "content")
    listed = wanted.groupBy(F.regexp_replace("file", "^file:/+", "/").alias("name")).agg(F.collect_list(F.struct("file", "stripe", "column_id", "kind", "offset", "length")).alias("streams"))

    def frames(batches):
        import pandas as pd

        for batch in batches:
            found = []
            for content, listed_ in zip(batch["content"], batch["streams"], strict=True):
                for s in listed_:
                    at, end, n, same, payload = s["offset"], s["offset"] + s["length"], 0, 0, 0
                    while at < end:
                        head = int.from_bytes(content[at : at + 3], "little")
                        n, same, payload, at = n + 1, same + (head & 1), payload + (head >> 1), at + 3 + (head >> 1)
                    found.append((s["file"], s["stripe"], s["column_id"], s["kind"], n, same, 3 * n, payload, at == end))
            yield pd.DataFrame(found, columns=["file", "stripe", "column_id", "kind", "blocks", "stored_as_is", "header_bytes", "payload_bytes", "whole"])

    return held.join(listed, "name").select("content", "streams").mapInPandas(frames, "file string, stripe int, column_id int, kind string, blocks int, stored_as_is int, header_bytes bigint, payload_bytes bigint, whole boolean")


def _measures(s) -> list:
    kind = s.getClass().getSimpleName().split("Statistics")[0].removesuffix("64").removesuffix("Instant")
    out = dict.fromkeys(_MEASURES)
    some = s.getNumberOfValues() > 0
    if kind == "Integer":
        out |= {"int_min": s.getMinimum(), "int_max": s.getMaximum()} if some else {}
        out["int_sum"] = s.getSum() if s.isSumDefined() else None
    elif kind == "Double":
        out |= {"double_min": s.getMinimum(), "double_max": s.getMaximum()} if some else {}
        out["double_sum"] = s.getSum()
    elif kind == "String":
        out |= {"string_min": s.getMinimum(), "string_max": s.getMaximum()} if some else {}
        out["total_length"] = s.getSum()
    elif kind == "Binary":
        out["total_length"] = s.getSum()
    elif kind == "Boolean":
        out["true_count"] = s.getTrueCount()
    elif kind == "Date" and some:
        first = datetime.date(1970, 1, 1)
        out |= {"date_min": first + datetime.timedelta(s.getMinimumDayOfEpoch()), "date_max": first + datetime.timedelta(s.getMaximumDayOfEpoch())}
    elif kind == "Timestamp" and some:
        out |= {"millis_min": s.getMinimumUTC().getTime(), "millis_max": s.getMaximumUTC().getTime()}
    elif kind == "Decimal" and some:
        out |= {"decimal_min": s.getMinimum().toString(), "decimal_max": s.getMaximum().toString(), "decimal_sum": s.getSum().toString() if s.getSum() is not None else None}
    return [s.getNumberOfValues(), s.hasNull(), *out.values()]


def _varints(data: bytes) -> Iterator[int]:
    value = shift = 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            yield value
            value = shift = 0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message: a number, or the bytes of what is stored with a length or fixed."""

    def varint() -> int:
        nonlocal at
        first = at
        while data[at] > 127:
            at += 1
        at += 1
        return next(_varints(data[first:at]))

    at = 0
    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


def _stored_measures(data: bytes) -> list:
    """What `_measures` says, of the serialized statistics."""
    own = dict(_fields(data))
    out, some = dict.fromkeys(_MEASURES), own.get(1, 0) > 0

    def of(number: int, convert: Callable, **names: int) -> None:
        held = dict(_fields(own[number]))
        out.update((name, convert(held[k])) for name, k in names.items() if k in held)

    def signed(x: int) -> int:
        return (x >> 1) ^ -(x & 1)

    def real(x: bytes) -> float:
        return struct.unpack("<d", x)[0]

    def day(x: int) -> datetime.date:
        return datetime.date(1970, 1, 1) + datetime.timedelta(signed(x))

    if 2 in own:
        of(2, signed, **{"int_min": 1, "int_max": 2} if some else {}, int_sum=3)
    elif 3 in own:
        out["double_sum"] = 0.0
        of(3, real, **{"double_min": 1, "double_max": 2} if some else {}, double_sum=3)
    elif 4 in own:
        out["total_length"] = 0
        of(4, bytes.decode, **{"string_min": 1, "string_max": 2} if some else {})
        of(4, signed, total_length=3)
    elif 5 in own:
        of(5, lambda x: x if isinstance(x, int) else next(_varints(x)), true_count=1)
    elif 6 in own and some:
        of(6, bytes.decode, decimal_min=1, decimal_max=2, decimal_sum=3)
    elif 7 in own and some:
        of(7, day, date_min=1, date_max=2)
    elif 8 in own:
        out["total_length"] = 0
        of(8, signed, total_length=1)
    elif 9 in own and some:
        of(9, signed, millis_min=3, millis_max=4)
    return [own.get(1, 0), bool(own.get(10, True)), *out.values()]


def _entries(spark: SparkSession, path: str, columns: Collection[int] | None, rows_of: Callable, schema: str, chunk: int | None = None, **options) -> DataFrame:
    """file, stripe, row_group, column_id and rows_of(bytes) of every row index entry below the path, made by the executors."""

    def indexes(name: str, r) -> list[tuple]:
        width, found = r.getSchema().getMaximumId() + 1, []
        wanted = spark.sparkContext._gateway.new_array(spark._jvm.boolean, width)
        some = [k for k in range(width) if columns is None or k in columns]
        for k in some:
            wanted[k] = True
        reader = r.rows()
        try:
            for n in range(r.getStripes().size()):
                index = reader.readRowIndex(n, wanted, wanted).getRowGroupIndex()
                found += [(name, n, k, own.toByteArray()) for k in some if (own := index[k]) is not None]
        finally:
            reader.close()
        return found

    fields = [part.split() for part in schema.split(", ")]

    def opened(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "date": pa.date32(), "array<bigint>": pa.list_(pa.int64())}
        for batch in batches:
            for own in batch.to_pylist():
                entries = (value for number, value in _fields(own["entries"]) if number == 1)
                found = [(own["file"], own["stripe"], g, own["column_id"], *rows_of(entry)) for g, entry in enumerate(entries)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kinds[kind]) for x, (_, kind) in zip(zip(*found, strict=True), fields, strict=True)], names=[name for name, _ in fields])

    stored = _table(spark, path, indexes, "file string, stripe int, column_id int, entries binary", chunk or INDEX_CHUNK, **options)
    return stored.mapInArrow(opened, schema)


def statistics(spark: SparkSession, path: str, level: str = "file", columns: Collection[int] | None = None, **options) -> DataFrame:
    """Stored column statistics by file, stripe or row_group: STATISTICS_SCHEMA, with null for what doesn't apply; of the given columns or all."""
    if level not in ("file", "stripe", "row_group"):
        raise ValueError("level is 'file', 'stripe' or 'row_group'")

    def rows(name: str, r) -> list[tuple]:
        if level == "file":
            return [(name, None, None, k, *_measures(s)) for k, s in enumerate(r.getStatistics()) if columns is None or k in columns]
        return [(name, n, None, k, *_measures(s)) for n, stripe in enumerate(r.getStripeStatistics()) for k, s in enumerate(stripe.getColumnStatistics()) if columns is None or k in columns]

    def entry_rows(entry: bytes) -> list:
        return _stored_measures(dict(_fields(entry)).get(2, b""))

    if level == "row_group":
        return _entries(spark, path, columns, entry_rows, STATISTICS_SCHEMA, **options)
    return _table(spark, path, rows, STATISTICS_SCHEMA, **options)


def running_groups(stored: DataFrame) -> DataFrame:
    """Row-group statistics with row_group counted on from stripe to stripe and file to file, where it starts at 0 in each stripe."""
    stripes_ = stored.groupBy("file", "stripe").agg((F.max("row_group") + 1).alias("groups"))
    earlier = W.orderBy("file", "stripe").rowsBetween(W.unboundedPreceding, -1)
    before = stripes_.select("file", "stripe", F.coalesce(F.sum("groups").over(earlier), F.lit(0)).alias("before"))
    return stored.join(before, ["file", "stripe"]).withColumn("row_group", (F.col("row_group") + F.col("before")).cast("int")).select(stored.columns)
