"""Token-id output: flat files of unsigned integers, with 64-bit document offsets.

Layout of a folder, one set of files for each shard (a range of document ids, ascending over shards and within):

``tokens-00007.bin``   the ids, end id after each document, as little-endian unsigned integers
``offsets-00007.bin``  n+1 unsigned 64-bit integers: where each document starts within the shard, and its end
``docs-00007.bin``     n signed 64-bit document ids (the lowest value stands for a null id)
``manifest.json``      integer type, and for each shard its documents, tokens and base (the tokens of all shards before)

The bases are prefix sums over one count for each shard, so no worker waits for another. A shard is written under a
name of its own attempt and then renamed: a task that runs again leaves the same files.

Nulls and edges: a null text is empty and gets the end id alone; a null id sorts first; rows that repeat are kept, each
as a document; other columns are ignored; an empty table gives a manifest without shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import fresh_path, slices, table
from .encoding import Encoder, default_tokenizer

NULL_ID = -(2**63)
_SHARD = pa.schema([("shard", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_tokens(docs: DataFrame, uri: str, tokenizer: str, end_id: int = 0, type_: str | None = None) -> dict[str, Any]:
    """Encode ``text`` of each document and write the folder ``uri``; returns the manifest.

    ``uri`` is in a store that all executors reach, by a scheme that pyarrow knows (file, hdfs, s3, gs, abfs).
    One shuffle of the texts, by ranges of ``doc_id``; texts of any length stream through a task in small groups.
    ``type_``: ``u2`` or ``u4``; the smallest that holds the vocabulary unless given.
    """
    type_ = type_ or ("u2" if max(Encoder.of(tokenizer).vocabulary, end_id + 1) <= 2**16 else "u4")
    end = np.array([end_id], "<u4").tobytes()

    def shard(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder.of(tokenizer), TaskContext.get()
        store, folder = pafs.FileSystem.from_uri(uri)
        number, attempt = task.partitionId(), task.taskAttemptId()
        names = [f"{folder}/{kind}-{number:05d}.bin" for kind in ("tokens", "offsets", "docs")]
        at, n, files = 0, 0, []
        for batch in rows:
            if not files:
                files = [store.open_output_stream(f"{x}.{attempt}") for x in names]
                files[1].write(np.zeros(1, "<u8").tobytes())
            texts = batch.column(1).to_pylist()
            files[2].write(np.array(batch.column(0).fill_null(NULL_ID), "<i8").tobytes())
            for lo, hi in slices([len(x or "") for x in texts], 1 << 20):
                parts = encoder.encode(texts[lo:hi])
                ends = at + np.cumsum(np.array([len(x) // 4 + 1 for x in parts], "<u8"))
                files[0].write(np.frombuffer(end.join([*parts, b""]), "<u4").astype(f"<{type_}").tobytes())
                files[1].write(ends.astype("<u8").tobytes())
                at, n = int(ends[-1]), n + len(parts)
        for f, name in zip(files, names):
            f.close()
            store.move(f"{name}.{attempt}", name)
        if n:
            yield pa.RecordBatch.from_pydict({"shard": [number], "documents": [n], "tokens": [at]}, schema=_SHARD)

    store, folder = pafs.FileSystem.from_uri(uri)
    store.create_dir(folder, recursive=True)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    counts = ordered.mapInArrow(shard, "shard long, documents long, tokens long").collect()  # a row for each shard
    shards, base = [], 0
    for number, documents, tokens in sorted(map(tuple, counts)):
        shards.append({"shard": number, "documents": documents, "tokens": tokens, "base": base})
        base += tokens
    manifest = {"type": type_, "end_id": end_id, "tokens": base, "shards": shards}
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def mapped(uri: str, name: str, type_: str) -> np.ndarray:
    """A file of the folder as an array: memory-mapped where the store is a local or mounted one."""
    store, folder = pafs.FileSystem.from_uri(uri)
    path = f"{folder}/{name}"
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, f"<{type_}", "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), f"<{type_}")


def read_documents(spark: SparkSession, uri: str) -> DataFrame:
    """Per document of a folder: id, start among all ids, number of ids, crc32 of them as unsigned 32-bit integers."""
    store, folder = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    type_ = manifest["type"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for x in batch.to_pylist():
                number = f"{x['shard']:05d}.bin"
                ids, offsets = mapped(uri, f"tokens-{number}", type_), mapped(uri, f"offsets-{number}", "u8").astype("i8")
                names = mapped(uri, f"docs-{number}", "i8")
                for lo, hi in slices(np.diff(offsets).tolist(), 1 << 20):
                    some, at = names[lo:hi], offsets[lo : hi + 1]
                    raw = memoryview(ids[at[0] : at[-1]].astype("<u4").tobytes())
                    cut = ((at - at[0]) * 4).tolist()
                    crc = [zlib.crc32(raw[s:e]) for s, e in zip(cut[:-1], cut[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64(), mask=some == NULL_ID), pa.array(at[:-1] + x["base"]), pa.array(np.diff(at)), pa.array(crc, pa.int64())], schema=_READ)

    shards = [(s["shard"], s["base"]) for s in manifest["shards"]]
    return spark.createDataFrame(shards, "shard long, base long").repartition(len(shards)).mapInArrow(read, schema)


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` as token files, read back."""
    uri = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), uri, default_tokenizer())
    return read_documents(spark, uri)


QUERIES = {"op1_token_output": op1_token_output}
