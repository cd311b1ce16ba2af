"""Length-delimited binary records of token ids (operator 3).

Each record is framed like this (little-endian):

    length of the payload   unsigned 64-bit
    its checksum            unsigned 32-bit, masked
    payload                 width of an id (2 or 4), 1 if doc_id is NULL, doc_id (signed 64-bit), the ids
    the payload's checksum  unsigned 32-bit, masked
    newline                 one byte

A masked checksum is the crc32 turned right by 15 bits plus a constant, so that
a checksum stored among checksummed bytes stays meaningful.  Ids take two bytes
if the tokenizer has at most 65,536.  Files are written by Spark's own writer
and its commit protocol, so a lost executor leaves no half-written file.  The
index is a separate Parquet table with one row per record."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dailycast.llm import common, tokens
from dailycast.session import scratch_path

# Fixed values of the masking rule.
MASK_TURN, MASK_ADD = 15, 0xA282EAD8
HEAD = struct.Struct("<QI")
INFO = struct.Struct("<BBq")
INDEX = ("file string, part int, split int, record int, doc_id long, at long, size long, "
         "local_start long, n_tokens long, ids_crc32 long")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_TURN) | (c << (32 - MASK_TURN))) + MASK_ADD) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    """One record without its closing newline."""
    body = INFO.pack(width, doc_id is None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(size)) + body + struct.pack("<I", masked(body))


def unframe(data, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at a byte of a file: doc_id, ids, and where the next one begins."""
    size, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at:at + 8])) != check:
        raise ValueError(f"damaged record length at byte {at}")
    body = bytes(data[at + HEAD.size:at + HEAD.size + size])
    end = at + HEAD.size + size
    if len(body) != size or masked(body) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"damaged record at byte {at}")
    width, null, doc_id = INFO.unpack_from(body)
    return None if null else doc_id, np.frombuffer(body, f"<u{width}", offset=INFO.size), end + 5


def write_records(docs: DataFrame, path: str, vocabulary: str | None = None, records_per_file: int = 20_000,
                  id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts, end each with the end id, and write them in ascending id order.

    NULL texts count as empty (the end id alone).  NULL ids come first; rows of
    the same id follow each other in an order that their text decides.  Other
    columns are not read; an empty table gives files without records."""
    spark = docs.sparkSession
    common.python_ready(spark)
    text = tokens.vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast(text)  # one file, 1.7 MB

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(shared.value)
        width = 2 if encoder.size <= 1 << 16 else 4
        for batch in batches:
            for docs, ids in tokens.ids_of(batch, encoder):
                out = [frame(d, x, width) for d, x in zip(docs, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = (picked.repartitionByRange(common.shuffle_partitions(spark), "doc_id", tie)
               .sortWithinPartitions("doc_id", tie))
    (ordered.mapInArrow(frames, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).text(path))


def build_index(spark: SparkSession, path: str) -> DataFrame:
    """Read every file whole, check every checksum, and list the records (see ``INDEX``)."""
    common.python_ready(spark)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, part, split, data in zip(*(batch.column(i) for i in range(4))):
                view, at, start, rows = memoryview(data.as_buffer()), 0, 0, []
                while at < len(view):
                    doc_id, ids, after = unframe(view, at)
                    rows.append((file.as_py(), part.as_py(), split.as_py(), len(rows), doc_id, at, after - at, start,
                                 len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at, start = after, start + len(ids)
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(name.alias("file"), F.regexp_extract(name, r"part-(\d+)", 1).cast("int").alias("part"),
                         F.regexp_extract(name, r"-c(\d+)\.txt$", 1).cast("int").alias("split"), "content")
    return files.mapInArrow(scan, INDEX)


def write_index(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    build_index(spark, path).write.parquet(index_path)
    return spark.read.schema(INDEX).parquet(index_path)


def read_ordered(index: DataFrame) -> DataFrame:
    """Each record in the files' order with ``start``, the ids of all records before it."""
    before = Window.orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)
    files = index.groupBy("file", "part", "split").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row per file
    return index.join(files, "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"),
                                            "n_tokens", "ids_crc32", "file", "at", "size")


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int) -> DataFrame:
    """All records, found through the index, in a random order that ``seed`` fixes: doc_id, ids."""
    common.python_ready(spark)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, places, data in zip(*(batch.column(i) for i in range(3))):
                view, rows = memoryview(data.as_buffer()), [unframe(memoryview(data.as_buffer()), p["at"]) for p in places.as_py()]
                del view
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["key"] for p in places.as_py()], pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1].tolist() for r in rows], pa.list_(pa.int32()))], ["key", "doc_id", "ids"])

    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(name.alias("file"), "content")
    key = F.xxhash64(F.lit(seed), "file", "record")
    places = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct(key.alias("key"), "at"))).alias("places"))
    found = files.join(places, "file").select("file", "places", "content").mapInArrow(pick, "key long, doc_id long, ids array<int>")
    return found.repartitionByRange(common.shuffle_partitions(spark), "key").sortWithinPartitions("key").drop("key")


def record_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write ``docs`` as records with their index in the shared folder, and read them back in order."""
    spark = docs.sparkSession
    path = scratch_path(spark, "records")
    write_records(docs, path + "/data", vocabulary)
    return read_ordered(write_index(spark, path + "/data", path + "/index"))
