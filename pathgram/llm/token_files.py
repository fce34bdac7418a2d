"""Token files: ids bit-packed at the fewest bits the vocabulary needs.

A token folder holds one Parquet row per block. A block has whole documents in order, about
``block_ids`` ids (more for a longer document): ``shard``, ``block``, ``base`` (ids of the shard
before it), ``bits``, ``n_ids``, ``doc_ids``, ``offsets`` (first id of each document in the block)
and ``payload``, in which id k takes bits k * bits to (k + 1) * bits, the lowest bit first. So any
id or document can be reached by arithmetic, and a block unpacks with numpy at once. Files are
written by Spark's own committer: a lost executor's task is written again, never twice.

Documents lie in ascending id order (null ids first, equal ids by text) over ascending shards. A
null text counts as empty and holds the end id alone. An empty table gives an empty folder. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathgram.llm.common import running, whole
from pathgram.llm.encoding import encoder
from pathgram.session import materialise, scratch_path

BLOCK = "shard int, block int, base long, bits int, n_ids long, doc_ids array<long>, offsets array<long>, payload binary"
BLOCK_IDS = 1 << 16


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width little-endian bit packing."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block; only their bytes are looked at."""
    if bits in (8, 16, 32):
        size = bits // 8
        return np.frombuffer(payload, f"<u{size}", stop - start, start * size).astype("<u4")
    first = start * bits // 8
    raw = np.frombuffer(payload, np.uint8, -(-stop * bits // 8) - first, first)
    flat = np.unpackbits(raw, bitorder="little")[start * bits - first * 8 :][: (stop - start) * bits]
    return (flat.reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32).astype("<u4")


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, block_ids: int = BLOCK_IDS, shards: int | None = None) -> None:
    """Encodes ``text`` of every row and writes the token folder."""
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    rows = docs.select("doc_id", whole("text").alias("text"))
    rows = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        coder = encoder(tokenizer)
        bits = max(1, int(max(coder.size - 1, end_id)).bit_length())
        state = {"block": 0, "base": 0}

        def flush(doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            ids = np.concatenate(parts)
            starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
            row = [shard, state["block"], state["base"], bits, len(ids), doc_ids, starts.tolist(), pack(ids, bits)]
            state["block"] += 1
            state["base"] += len(ids)
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "base", "bits", "n_ids", "doc_ids", "offsets", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        doc_ids, parts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                parts.append(coder.ids(text.as_py(), end_id))
                doc_ids.append(doc_id)
                held += len(parts[-1])
                if held >= block_ids:
                    yield flush(doc_ids, parts)
                    doc_ids, parts, held = [], [], 0
        if parts:
            yield flush(doc_ids, parts)

    rows.mapInArrow(blocks, BLOCK).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token folder: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    totals = materialise(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")), "token-shards")
    before = running(totals, "shard", "n", "before")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends = [*row["offsets"][1:], row["n_ids"]]
                sums = [zlib.crc32(unpack(row["payload"], row["bits"], a, b).tobytes()) for a, b in zip(row["offsets"], ends, strict=True)]
                starts = np.array(row["offsets"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["before"]),
                        pa.array(np.array(ends, np.int64) - starts), pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return blocks.join(F.broadcast(before), "shard").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, shard: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` (places in one shard); reads only the blocks that hold them."""
    blocks = spark.read.schema(BLOCK).parquet(path).filter((F.col("shard") == shard) & (F.col("base") < stop) & (F.col("base") + F.col("n_ids") > start))
    parts = [unpack(b.payload, b.bits, max(0, start - b.base), min(b.n_ids, stop - b.base)) for b in blocks.orderBy("base").toLocalIterator()]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the token folder to the shared scratch folder and describes its documents from it."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, end_id, path)
    return read_documents(docs.sparkSession, path)
