"""Token ids in sorted-string-table shards.

File layout, little-endian throughout; every part ends with a line feed, because Spark's text sink writes
the parts as rows. A shard has BLOCKS data blocks at most, and the sink begins a new file after as many rows as
that makes, so shards are bounded in bytes wherever long texts stand, but for a single longer text:

* data blocks of about BLOCK bytes. Entry: bytes shared with the previous key (u8), bytes that follow (u8),
  value bytes (u32), the rest of the key, the value (ids as u16 or u32). The first key of a block is whole.
* tail: the sparse index (per block: offset u64, bytes u32, first key's length u8, first key), the Bloom
  filter's bits, and a footer of fixed size (index offset u64, index bytes u64, filter bytes u64, entries u64,
  ids u64, bytes per id u8, hashes u8, MAGIC).

A key is the document's number with its sign bit flipped, big-endian, so that byte order is number order; a
null number is the empty key and comes first. Repeated numbers are kept, in any order. A null text has
the end id alone. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import Encoder
from .common import fresh_path, held, quoted, slots, small_batches, trim, written

MAGIC = b"FQSST01\n"
FOOTER = struct.Struct("<QQQQQBB8s")
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<QIB")
BLOCK = 64 << 10
#: Data blocks of a full shard, and text bytes that one task writes shards of.
BLOCKS, TASK = 255, 128 << 20
BITS_PER_KEY, HASHES = 10, 7

def encoder(path: str, memory: int | None = None) -> Encoder:
    """One encoder per worker process, so that its word table outlives a task."""
    return held(f"{path} {memory}", lambda: Encoder(path, memory))


def key_of(number: int | None) -> bytes:
    return b"" if number is None else ((number + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def number_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def bloom_positions(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class ShardWriter:
    """Turns entries in key order into the parts of one shard."""

    def __init__(self, id_bytes: int, size: int = BLOCK):
        self.id_bytes, self.size, self.block, self.last = id_bytes, size, bytearray(), b""
        self.index, self.keys, self.offset, self.ids, self.first = bytearray(), [], 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray):
        """Yields a finished block, if the entry completes one."""
        if not self.block:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        value = ids.astype("<u2" if self.id_bytes == 2 else "<u4").tobytes()
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= self.size:
            yield self.flush()

    def flush(self) -> bytes:
        part = bytes(self.block) + b"\n"
        self.index += INDEX.pack(self.offset, len(self.block), len(self.first)) + self.first
        self.offset += len(part)
        self.block = bytearray()
        return part

    def close(self):
        if self.block:
            yield self.flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        filled = np.zeros((bits + 7) // 8 * 8, np.uint8)
        for key in self.keys:
            filled[bloom_positions(key, len(filled))] = 1
        bloom = np.packbits(filled).tobytes()
        yield bytes(self.index) + bloom + FOOTER.pack(self.offset, len(self.index), len(bloom), len(self.keys), self.ids, self.id_bytes, HASHES, MAGIC)


class Shard:
    """A shard's bytes, opened by its footer."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        at, index, bloom, self.entries, self.ids, self.id_bytes, _, magic = FOOTER.unpack(self.data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.bloom = np.unpackbits(np.frombuffer(self.data[at + index : at + index + bloom], np.uint8))
        self.blocks, k = [], at
        while k < at + index:
            offset, size, length = INDEX.unpack_from(self.data, k)
            k += INDEX.size
            self.blocks.append((bytes(self.data[k : k + length]), offset, size))
            k += length

    def read(self, block: int):
        """(key, ids) of a block's entries."""
        _, at, size = self.blocks[block]
        end, key = at + size, b""
        while at < end:
            shared, rest, length = ENTRY.unpack_from(self.data, at)
            at += ENTRY.size
            key = key[:shared] + bytes(self.data[at : at + rest])
            at += rest
            yield key, np.frombuffer(self.data[at : at + length], "<u2" if self.id_bytes == 2 else "<u4")
            at += length

    def find(self, number: int | None) -> list[np.ndarray]:
        """Ids of the documents of that number: the filter, then binary search in the index, then a block or a few."""
        from bisect import bisect_left

        key = key_of(number)
        if not all(self.bloom[bloom_positions(key, len(self.bloom))]):
            return []
        found = []
        for block in range(max(0, bisect_left([x[0] for x in self.blocks], key) - 1), len(self.blocks)):
            if self.blocks[block][0] > key:
                break
            found += [ids for k, ids in self.read(block) if k == key]
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode every text and write the shards of all documents into path, ordered by number over all shards."""
    cut = small_batches(docs).select(F.col(quoted(id_column)).cast("long").alias("id"), F.coalesce(F.col(quoted(text_column)), F.lit("")).alias("text"))
    size = cut.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks, blocks, block = max(slots(docs), -(-size // TASK)), BLOCKS, BLOCK

    def build(batches):
        enc = encoder(tokenizer)
        width = 2 if max(enc.library.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        writer, full = ShardWriter(width, block), 0

        def row(part):
            return pa.RecordBatch.from_pydict({"part": pa.array([part[:-1]], pa.binary())})

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id))
                for part in writer.add(key_of(number), ids):
                    yield row(part)
                    full += 1
                if full == blocks:
                    yield from map(row, writer.close())
                    writer, full = ShardWriter(width, block), 0
            trim()
        if writer.keys:
            yield from map(row, writer.close())

    spread = cut.repartitionByRange(tasks, "id").sortWithinPartitions("id")
    parts = spread.mapInArrow(build, "part binary").select(F.col("part").cast("string").alias("value"))
    parts.write.option("compression", "none").option("maxRecordsPerFile", blocks + 1).text(path)


def shard_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and content of the shards in a folder, or of the named files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(paths).where("length > 0").select("path", "content")


def write_manifest(spark: SparkSession, path: str, manifest: str) -> None:
    """A small Parquet table of the shards in path: file, lowest and highest number, entries, ids, filter."""

    def describe(batches):
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_buffer().to_pybytes())
                keys = [number_of(key) for key, _ in shard.read(len(shard.blocks) - 1)]
                rows.append((name, number_of(shard.blocks[0][0]), keys[-1], shard.entries, shard.ids, np.packbits(shard.bloom).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    names, types = ["file", "low", "high", "entries", "ids", "filter"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    shard_files(spark, path).mapInArrow(describe, "file string, low long, high long, entries long, ids long, filter binary").write.parquet(manifest)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, local_start, n_tokens, ids_crc32 and the ids of every entry in the files of path."""

    def parse(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_buffer().to_pybytes())
                start = 0
                for block in range(len(shard.blocks)):
                    rows = [(number_of(key), ids.astype("<u4")) for key, ids in shard.read(block)]
                    size = [len(ids) for _, ids in rows]
                    starts = start + np.cumsum([0, *size[:-1]])
                    start += sum(size)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": [name] * len(rows),
                            "doc_id": pa.array([x for x, _ in rows], pa.int64()),
                            "local_start": pa.array(starts, pa.int64()),
                            "n_tokens": pa.array(size, pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(ids.tobytes()) for _, ids in rows], pa.int64()),
                            "ids": pa.array([ids.tobytes() for _, ids in rows], pa.binary()),
                        }
                    )

    return shard_files(spark, path).mapInArrow(parse, "shard string, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary")


def lookup(spark: SparkSession, path: str, numbers: list[int | None], manifest: str | None = None) -> DataFrame:
    """doc_id and ids of a few documents (a null number is one, too) in the shards of path.

    With a manifest, its key ranges and filters name the shards that can hold them, and only these files are read;
    else all are. In a shard, its filter and the sparse index lead to the block.
    """

    @F.pandas_udf("boolean")
    def may_hold(lows, highs, filters):
        import pandas as pd

        out = []
        for low, high, data in zip(lows, highs, filters):
            bits = np.unpackbits(np.frombuffer(data, np.uint8))
            low, high = (b"" if pd.isna(x) else key_of(int(x)) for x in (low, high))
            out.append(any(low <= key_of(n) <= high and all(bits[bloom_positions(key_of(n), len(bits))]) for n in numbers))
        return pd.Series(out, dtype=bool)

    def find(batches):
        for batch in batches:
            for data in batch.column(1):
                shard = Shard(data.as_buffer().to_pybytes())
                rows = [(n, ids.astype("<u4").tobytes()) for n in numbers for ids in shard.find(n)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([n for n, _ in rows], pa.int64()), "ids": pa.array([x for _, x in rows], pa.binary())})

    shape = "doc_id long, ids binary"
    if manifest is None:
        return shard_files(spark, path).mapInArrow(find, shape)
    told = [n for n in numbers if n is not None]
    some = F.lit(False)
    if told:
        some = (F.col("high") >= min(told)) & (F.coalesce(F.col("low"), F.lit(min(told))) <= max(told))
    if len(told) < len(numbers):
        some = some | F.col("low").isNull()
    ranged = spark.read.parquet(manifest).where(some)
    files = [r["file"] for r in ranged.where(may_hold(F.col("low").cast("string"), F.col("high").cast("string"), F.col("filter"))).select("file").collect()]
    return shard_files(spark, files).mapInArrow(find, shape) if files else spark.createDataFrame([], shape)


def with_starts(entries: DataFrame) -> DataFrame:
    """Add start, the ids of all documents before: the sums of the shards before, and local_start.

    The sums are one row per shard, so that the one window over all of them stays small.
    """
    entries = written(entries, "entries")
    sums = entries.groupBy("shard").agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("none"), F.sum("n_tokens").alias("n"))
    # a number's shards have one task, whose files are numbered; shards with null numbers come first
    order = [F.when(~F.col("none"), F.col("low")).asc_nulls_first(), F.length("shard"), F.col("shard")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return entries.join(base, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_shards(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the shards of docs into the shared folder and return what they hold, one row per document."""
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    write_shards(docs, path, tokenizer, end_id)
    return with_starts(read_shards(spark, path).drop("ids"))
