"""Token-id files: frequency-ranked ids, byte-aligned, control bytes apart from data bytes.

A file holds consecutive documents in ascending doc_id order.  An id is written as its rank by
frequency in 1 to 4 bytes; the 2-bit byte counts of four ids share a control byte, and all
control bytes stand before the data bytes, so that decoding is table lookups over whole arrays.

File: b"FVB1", then little-endian int64 counts of documents, ids and data bytes; doc_ids (int64,
after a byte each that is 1 for a null one); ids of each document (uint32); control bytes; data
bytes; crc32 (uint32) of all that.  The ranks are a table beside the files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_partitions, new_dir
from .files import read_file, write_file
from .tokens import tokenizer_for

MAGIC = b"FVB1"
#: Ids in one file, a longer document excepted.
FILE_TOKENS = 4_000_000

_COUNTS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = ranks.astype("<u4")
    sizes = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = sizes - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) < sizes[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    sizes = _COUNTS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    used = np.arange(4, dtype=np.uint8) < sizes[:, None]
    out = np.zeros((n, 4), np.uint8)
    out[used] = np.frombuffer(data, np.uint8)
    return out.reshape(-1).view("<u4")


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    counts = np.array([len(doc_ids), len(ranks), len(data)], "<i8").tobytes()
    missing = bytes(d is None for d in doc_ids)
    ids = np.array([d or 0 for d in doc_ids], "<i8").tobytes()
    body = b"".join([MAGIC, counts, missing, ids, lengths.astype("<u4").tobytes(), control, data])
    return body + zlib.crc32(body).to_bytes(4, "little")


def decode_file(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ranks of a file; ValueError if it is damaged."""
    if raw[:4] != MAGIC or zlib.crc32(raw[:-4]) != int.from_bytes(raw[-4:], "little"):
        raise ValueError("not a whole token-id file")
    n, total, n_data = np.frombuffer(raw, "<i8", 3, 4).tolist()
    at = 28
    missing = raw[at : at + n]
    ids = np.frombuffer(raw, "<i8", n, at + n).tolist()
    at += 9 * n
    lengths = np.frombuffer(raw, "<u4", n, at).astype(np.int64)
    at += 4 * n
    n_control = -(-total // 4)
    ranks = decode_ranks(raw[at : at + n_control], raw[at + n_control : at + n_control + n_data], total)
    return [None if m else d for m, d in zip(missing, ids, strict=True)], lengths, ranks


def _is_narrow(tokenizer_path: str, end_id: int) -> bool:
    """Whether two bytes hold every id."""
    return max(tokenizer_for(tokenizer_path).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16


def _blocks(docs: DataFrame, tokenizer_path: str, end_id: int, file_tokens: int) -> DataFrame:
    """Runs of consecutive documents with their ids, in ascending doc_id order by shard and block."""
    schema = "shard int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, ids binary"
    narrow = _is_narrow(tokenizer_path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer_for(tokenizer_path), int(end_id).to_bytes(4, "little")
        shard, block = TaskContext.get().partitionId(), 0
        names, sizes, parts, held = [], [], [], 0

        def whole() -> pa.RecordBatch:
            cols = [[shard], [block], [held], [names], [sizes], [b"".join(parts)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["shard", "block", "n_tokens", "doc_ids", "lengths", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = tok.encode(text) + end
                n = len(data) // 4
                if names and held + n > file_tokens:
                    yield whole()
                    block += 1
                    names, sizes, parts, held = [], [], [], 0
                names.append(doc)
                sizes.append(n)
                parts.append(np.frombuffer(data, "<u4").astype("<u2").tobytes() if narrow else data)
                held += n
        if names:
            yield whole()

    ordered = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.monotonically_increasing_id().alias("number"),
    )
    # a doc_id, or none, that very many rows share is split by how its texts begin, which goes with
    # their order, and equal texts by their numbers, which makes no difference to the files
    head = F.substring("text", 1, 32)
    ordered = ordered.repartitionByRange(n_partitions(docs.sparkSession), "doc_id", head, "number")
    return ordered.sortWithinPartitions("doc_id", "text").select("doc_id", "text").mapInArrow(run, schema)


def write_token_files(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, file_tokens: int = FILE_TOKENS
) -> tuple[DataFrame, DataFrame]:
    """Write the token-id files of docs; (manifest, ranks).

    manifest has a row for each file: file, shard, block, n_tokens and first, the ids of all files
    before it.  ranks has id, n and rank for each id that occurs; ties go by id.  Every document is
    its ids and then end_id, so a null or empty text is end_id alone.  A null doc_id sorts first;
    documents that share a doc_id stand by text, and repeated rows are documents of their own.  Further
    columns of docs are left out.  No rows give no files.
    """
    spark = docs.sparkSession
    folder = new_dir(spark, "tokens")
    tok = tokenizer_for(tokenizer_path)
    size, narrow = max(tok.tokenizer.get_vocab_size(), end_id + 1), _is_narrow(tokenizer_path, end_id)
    blocks = materialize(_blocks(docs, tokenizer_path, end_id, file_tokens), "tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                total += np.bincount(np.frombuffer(raw.as_buffer(), "<u2" if narrow else "<u4"), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counted = blocks.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # the vocabulary bounds this table, however large the corpus is
    by_rank = sorted(((-r.n, r.id) for r in counted.collect()))
    rank_of = np.zeros(size, np.uint32)
    rank_of[[i for _, i in by_rank]] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = materialize(
        spark.createDataFrame([(i, -n, k) for k, (n, i) in enumerate(by_rank)], "id long, n long, rank long"), "ranks"
    )
    known = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(5)[i].as_buffer(), "<u2" if narrow else "<u4")
                raw = encode_file(
                    batch.column(3)[i].as_py(), np.array(batch.column(4)[i].as_py(), np.int64), known.value[ids]
                )
                shard, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                files.append(write_file(folder, f"ids-{shard:06d}-{block:06d}.fvb", raw))
            yield pa.RecordBatch.from_arrays(
                [pa.array(files), batch.column(0), batch.column(1), batch.column(2)],
                ["file", "shard", "block", "n_tokens"],
            )

    written = materialize(blocks.mapInArrow(write, "file string, shard int, block int, n_tokens long"), "files")
    # one row for each shard, of which there are as many as tasks, and one for each file in a shard
    shards = written.groupBy("shard").agg(F.sum("n_tokens").alias("all"))
    shards = shards.select(F.col("shard").alias("_shard"), (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("earlier"))
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")
    first = written.withColumn("inside", inside).join(shards, F.col("shard") == F.col("_shard"))
    return first.withColumn("first", F.col("earlier") + F.col("inside")).drop("_shard", "earlier", "inside"), ranks


def read_token_files(manifest: DataFrame, ranks: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids of every document of the files.  An empty manifest gives no rows."""
    spark = manifest.sparkSession
    table = ranks.orderBy("rank").select("id").collect()  # bounded by the vocabulary
    known = spark.sparkContext.broadcast(np.array([r.id for r in table], "<u4"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs, lengths, ranked = decode_file(read_file(file))
                ids = known.value[ranked]
                ends = np.concatenate([[0], np.cumsum(lengths)])
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                arrays = [pa.array(docs, pa.int64()), pa.array(first + ends[:-1]), pa.array(lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    paths = manifest.select("file", "first").repartition(4 * n_partitions(spark), "file")
    return paths.mapInArrow(run, schema)
