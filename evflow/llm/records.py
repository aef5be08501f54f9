"""Length-delimited binary records of token ids, with a separate offset index for shuffled reads.

A record is: payload length (unsigned 64 bit), masked CRC-32 of those eight bytes, payload, masked CRC-32 of the
payload, all little-endian.  The mask turns the sum right by 15 bits and adds a constant, so that sums stored inside
checked data stay harmless.  A payload is a byte of flags (1: the document has an id, 2: wide ids), the document id
(signed 64 bit) and the token ids as unsigned 16-bit integers, or 32-bit where the vocabulary needs them.

Cases: a null or empty text gives a record of the end id alone; a null doc_id is kept and sorts first; equal doc_ids
each keep their record, in order of text; other columns of the input are left out; an empty table gives no record.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evflow.llm.store import new_path, open_file, stage
from evflow.llm.text import slices, text_view
from evflow.llm.tokenize import default_tokenizer, encoder, token_bytes

_MASK = 0xA282EAD8
_HEAD, _KEY, _SUM = "<QI", "<Bq", "<I"
_HEAD_SIZE, _KEY_SIZE = struct.calcsize(_HEAD), struct.calcsize(_KEY)
INDEX = "doc_id long, shard int, file string, at long, size long, before long, n_tokens long"


def masked_crc(data: bytes) -> int:
    """CRC-32, turned and shifted."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The payload with lengths and sums around it."""
    size = struct.pack("<Q", len(payload))
    return size + struct.pack(_SUM, masked_crc(size)) + payload + struct.pack(_SUM, masked_crc(payload))


def unframe(record: bytes) -> bytes:
    """The payload of a record; a length or sum that doesn't fit is an error."""
    size, head = struct.unpack_from(_HEAD, record)
    payload = record[_HEAD_SIZE : _HEAD_SIZE + size]
    if head != masked_crc(record[:8]) or len(payload) != size or struct.unpack_from(_SUM, record, _HEAD_SIZE + size)[0] != masked_crc(payload):
        raise ValueError("record is damaged")
    return payload


def write_records(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, shards: int | None = None, path: str | None = None) -> DataFrame:
    """Encode every text and write the ids in ascending doc_id order; return the offset index.

    One task writes one shard, under a name of its own attempt: the index names only files of tasks that ended well.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or new_path(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard, out, at, before = task.partitionId(), None, 0, 0
        file = f"{path}/shard-{shard:06d}-{task.taskAttemptId()}.rec"
        narrow = encoder(tokenizer).size <= 1 << 16
        end = struct.pack("<I", end_id)
        for batch in batches:
            for part in slices(batch):
                rows = []
                if out is None:
                    out = open_file(file, "wb")
                for doc, ids in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text"), tokenizer), strict=True):
                    ids += end
                    stored = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if narrow else ids
                    record = frame(struct.pack(_KEY, (doc is not None) + 2 * (not narrow), doc or 0) + stored)
                    out.write(record)
                    rows.append((doc, shard, file, at, len(record), before, len(ids) // 4))
                    at += len(record)
                    before += len(ids) // 4
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["doc_id", "shard", "file", "at", "size", "before", "n_tokens"])
        if out is not None:
            out.close()

    ordered = text_view(docs).repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(write, INDEX), "record-index")


def with_starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: tokens of all records before each one.  One row a shard goes through the window."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))
    return index.join(base.hint("shuffle_hash"), "shard").withColumn("start", F.col("base") + F.col("before")).drop("base")


def read_records(index: DataFrame, ids: bool = True) -> DataFrame:
    """Read the records that ``index`` names, each by its own offset, and check their sums.

    Any selection or order of the index may be read; ``ids`` adds the token ids beside their count and CRC-32.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            at, size, files = (batch.column(c).to_pylist() for c in ("at", "size", "file"))
            docs, counts, sums, kept = [], [], [], []
            for k in range(batch.num_rows):
                if files[k] != name:
                    name, source = files[k], open_file(files[k], "rb")
                source.seek(at[k])
                payload = unframe(source.read(size[k]))
                flags, doc = struct.unpack_from(_KEY, payload)
                found = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_KEY_SIZE).astype("<u4")
                docs.append(doc if flags & 1 else None)
                counts.append(len(found))
                sums.append(zlib.crc32(found.tobytes()))
                kept.append(found)
            columns = [pa.array(docs, pa.int64()), batch.column("start"), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if ids:
                columns.append(pa.array([x.astype(np.int32) for x in kept], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return index.select("file", "at", "size", "start").mapInArrow(read, schema)


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write, read back and sum up every document."""
    index = with_starts(write_records(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return read_records(index.repartition(n, "shard").sortWithinPartitions("file", "at"), ids=False)
