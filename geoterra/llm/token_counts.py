"""Token counts by a separator scan over flat token streams.

A stream is a run of token ids, documents ended by a separator id, without an index. It is taken in blocks that
know nothing of documents. Each block is searched for separators at once (numpy); a prefix scan over the blocks'
summaries then tells each block where the document that it starts in began and how many ended before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written
from .tokens import default_vocabulary, encode, width

BLOCKS = "stream string, block long, first long, ids binary, doc_ids binary"
#: A document's name in the manifest: whether its id is not null, and the id.
NAMED = np.dtype([("known", "u1"), ("id", "<i8")])
KINDS = {"uint16": np.dtype("<u2"), "uint32": np.dtype("<u4")}


def read_token_files(spark: SparkSession, path: str, kind: str = "uint16", block_tokens: int = 1 << 20, task_blocks: int = 64) -> DataFrame:
    """Blocks of flat token files of any length (little-endian ids, one file one stream).

    Only names and lengths are listed first; then each task reads its own range of ``task_blocks`` blocks of a file, seeking to it. Files must lie where
    Arrow's file systems reach (local, hdfs, s3, gs). An empty file is one block without ids; a length that is no whole number of ids ends the job.
    """
    size = KINDS[kind].itemsize
    step = block_tokens * size * task_blocks

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, start in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                if length % size:
                    raise ValueError(f"{name}: {length} bytes are no whole number of ids")
                system, place = FileSystem.from_uri(re.sub("^file:/+", "file:///", name))
                with system.open_input_file(place) as file:
                    for k in range(start, max(min(start + step, length), start + 1), block_tokens * size):
                        ids = file.read_at(min(block_tokens * size, length - k), k) if length else b""
                        yield pa.RecordBatch.from_pydict({"stream": [name], "block": pa.array([k // (block_tokens * size)], pa.int64()), "first": pa.array([k // size], pa.int64()), "ids": pa.array([ids], pa.binary()), "doc_ids": pa.array([None], pa.binary())})

    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").cast("long").alias("length"))
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("start"))
    return ranges.repartition("path", "start").mapInArrow(cut, BLOCKS)


def stream_kind(end_id: int, vocabulary: str | None = None) -> str:
    """The type of the ids of a stream: uint16 where all ids of the vocabulary fit."""
    found = width(vocabulary or default_vocabulary(), end_id)
    return next(k for k, v in KINDS.items() if v == found)


def write_token_stream(docs: DataFrame, end_id: int, vocabulary: str | None = None, block_tokens: int = 1 << 20) -> DataFrame:
    """Token streams of ``docs`` (doc_id, text), one for each task, as blocks in a table of the shared folder, of the type ``stream_kind``.

    Strings of special tokens are ordinary text, so ``end_id`` stands at the ends of documents alone if the vocabulary gives
    it to no ordinary text; else the job fails. ``doc_ids`` (the ids of the documents whose end a block holds) is a manifest
    that the scan never reads; it only names the counts afterwards. Null and empty texts are documents without tokens, a null doc_id
    stays null, repeated rows are documents of their own, other columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = KINDS[stream_kind(end_id, vocabulary)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, block, first = f"task-{TaskContext.get().partitionId():06d}", 0, 0
        held: list[np.ndarray] = []
        names: list[tuple[int, int | None]] = []  # (place of the separator, id)
        n = 0

        def emit(ids: np.ndarray, block: int, first: int, ended: list) -> pa.RecordBatch:
            ended_ids = np.array([(d is not None, d or 0) for _, d in ended], NAMED).tobytes()
            return pa.RecordBatch.from_pydict({"stream": [stream], "block": pa.array([block], pa.int64()), "first": pa.array([first], pa.int64()), "ids": pa.array([ids.astype(kind).tobytes()], pa.binary()), "doc_ids": pa.array([ended_ids], pa.binary())})

        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held += [encode(text.as_py(), vocabulary, special=False), np.array([end_id], np.uint32)]
                if (held[-2] == end_id).any():
                    raise ValueError(f"id {end_id} stands inside a text, so it cannot end documents")
                n += len(held[-2]) + 1
                names.append((first + n - 1, d))
                while n >= block_tokens:
                    ids = np.concatenate(held)
                    cut = sum(1 for at, _ in names if at < first + block_tokens)
                    yield emit(ids[:block_tokens], block, first, names[:cut])
                    held, names = [ids[block_tokens:]], names[cut:]
                    n -= block_tokens
                    block, first = block + 1, first + block_tokens
        if n:
            yield emit(np.concatenate(held), block, first, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, BLOCKS), "token-stream")


def scan(blocks: DataFrame, end_id: int, kind: str = "uint16") -> DataFrame:
    """Per document of each stream: stream, doc_no (from 0), start, n_tokens without the separator, and the block that its end stands in.

    Ids after the last separator are a document without end (``ended`` false). An empty stream has no documents.
    """
    dtype = KINDS[kind]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, sizes = [], []
            for first, ids in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                a = np.frombuffer(ids.as_buffer(), dtype)
                ends.append(np.flatnonzero(a == end_id) + first)
                sizes.append(len(a))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["stream", "block", "first", "size", "ends"])

    found = written(blocks.select("stream", "block", "first", "ids").mapInArrow(search, "stream string, block long, first long, size long, ends array<long>"), "separators")
    # The prefix scan runs over one small row for each block: how many ends it holds, and the last of them.
    summary = found.select("stream", "block", "first", "size", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    earlier = Window.partitionBy("stream").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_at = F.coalesce(F.max("last").over(earlier) + 1, F.lit(0))
    done = F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long")
    final = F.lead("block").over(Window.partitionBy("stream").orderBy("block")).isNull()
    carried = summary.select("stream", "block", open_at.alias("open_at"), done.alias("done"), (F.col("first") + F.col("size")).alias("stop"), final.alias("final"))
    stitched = found.select("stream", "block", "ends").join(carried, ["stream", "block"])
    starts = F.concat(F.array("open_at"), F.transform("ends", lambda e: e + 1))
    docs = F.zip_with(F.slice(starts, 1, F.size("ends")), F.col("ends"), lambda s, e: F.struct(s.alias("start"), (e - s).alias("n_tokens"), F.lit(True).alias("ended")))
    left = F.element_at(starts, -1)
    tail = F.when(F.col("final") & (F.col("stop") > left), F.array(F.struct(left.alias("start"), (F.col("stop") - left).alias("n_tokens"), F.lit(False).alias("ended")))).otherwise(F.array().cast("array<struct<start:bigint,n_tokens:bigint,ended:boolean>>"))
    return stitched.select("stream", "block", "done", F.posexplode(F.concat(docs, tail)).alias("i", "d")).select("stream", (F.col("done") + F.col("i")).alias("doc_no"), "block", F.col("i").cast("long").alias("i"), "d.start", "d.n_tokens", "d.ended")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """documents as token streams (end id 50256, which no ordinary text has), scanned: doc_id, stream, doc_no, start, n_tokens."""
    blocks = write_token_stream(spark.read.parquet(f"{sf_dir}/documents.parquet"), 50256)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stream, block, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a = np.frombuffer(ids, NAMED)
                yield pa.RecordBatch.from_arrays([pa.array([stream] * len(a)), pa.array([block] * len(a), pa.int64()), pa.array(np.arange(len(a))), pa.array(a["id"].copy(), mask=a["known"] == 0)], ["stream", "block", "i", "doc_id"])

    named = blocks.select("stream", "block", "doc_ids").mapInArrow(name, "stream string, block long, i long, doc_id long")
    return scan(blocks, 50256, stream_kind(50256)).join(named, ["stream", "block", "i"]).select("doc_id", "stream", "doc_no", "start", "n_tokens")


QUERIES = {"op1_token_counts": op1_token_counts}
