"""Operator 4: flat token-ID files with 64-bit document offsets.

A shard is a pair of files: ``*.bin`` holds little-endian unsigned integers (16 bits when
the vocabulary fits, else 32) of document after document; ``*.idx`` holds a header, the
document ids, a null mark for each and ``n + 1`` 64-bit offsets into the flat file.
Documents are range-partitioned by id, so shard k holds smaller ids than shard k + 1 and a
document's global start is its shard's base, a prefix sum of the shards' sizes, plus its
offset. Readers memory-map the flat file.

A task writes under a name of its own attempt; the manifest goes through Spark's commit
protocol, so only files of attempts that succeeded are ever read.

Defined cases: null text counts as empty and yields the end id alone; null ids come first;
rows that share an id follow each other in text order; an empty table writes no document.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.shared import NULL_ID, file_system, local_copy, new_folder, sent_id
from scholium.llm.tokens import encoder

MAGIC = b"SCHOTOK1"
HEADER = "<8sHxxxxxxQQ"
MANIFEST = "shard int, bin string, idx string, n_docs long, n_tokens long, width int"


def _writer(folder: str, vocabulary: str | None, end_id: int):
    def write(batches):
        import pandas as pd
        from pyspark import TaskContext

        enc = encoder(vocabulary)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        shard = TaskContext.get().partitionId()
        store, root = file_system(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        ids, nulls, sizes = [], [], []
        with store.open_output_stream(f"{root}/{name}.bin", buffer_size=1 << 20) as out:
            for batch in batches:
                coded = enc.encode([t or "" for t in batch["text"]])
                end = np.array([end_id], np.uint32)
                parts = [x for c in coded for x in (c, end)]
                if parts:
                    out.write(np.concatenate(parts).astype(f"<u{width}").tobytes())
                sizes.append(np.fromiter((len(c) + 1 for c in coded), np.int64, len(coded)))
                nulls.append((batch["doc_id"].to_numpy() == NULL_ID).astype(np.uint8))
                ids.append(batch["doc_id"].to_numpy(np.int64))
        ids, nulls, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids, nulls, sizes))
        offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        with store.open_output_stream(f"{root}/{name}.idx") as out:
            out.write(struct.pack(HEADER, MAGIC, width, len(ids), int(offsets[-1])))
            for part in (ids.astype("<i8"), nulls.astype("<u1"), offsets.astype("<u8")):
                out.write(part.tobytes())
        yield pd.DataFrame({"shard": [shard], "bin": [f"{folder}/{name}.bin"], "idx": [f"{folder}/{name}.idx"], "n_docs": [len(ids)], "n_tokens": [int(offsets[-1])], "width": [width]})

    return write


def write_token_files(spark: SparkSession, docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """Write shards in ascending doc_id order; returns the committed manifest (a row per shard) with global bases."""
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(sent_id("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInPandas(_writer(folder, vocabulary, end_id), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    shards = sorted((r for r in spark.read.parquet(f"{folder}/manifest").collect()), key=lambda r: r["shard"])  # a row per partition
    base, out = 0, []
    for r in shards:
        out.append((*r, base))
        base += r["n_tokens"]
    return spark.createDataFrame(out, f"{MANIFEST}, base long")


class Shard:
    """A memory-mapped shard: ``len(shard)``, ``shard.ids[k]`` (None where null) and ``shard[k]``, the ids of document k."""

    def __init__(self, bin_path: str, idx_path: str):
        with open(idx_path, "rb") as f:
            magic, width, n, total = struct.unpack(HEADER, f.read(struct.calcsize(HEADER)))
            if magic != MAGIC:
                raise ValueError(f"not a token index: {idx_path}")
            ids = np.frombuffer(f.read(8 * n), "<i8")
            nulls = np.frombuffer(f.read(n), "<u1")
            self.offsets = np.frombuffer(f.read(8 * (n + 1)), "<u8")
        self.ids = [None if gone else int(i) for i, gone in zip(ids, nulls, strict=True)]
        self.flat = np.memmap(bin_path, f"<u{width}", "r", shape=(total,)) if total else np.zeros(0, f"<u{width}")

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.flat[int(self.offsets[k]) : int(self.offsets[k + 1])]


def _reader(batches):
    import pandas as pd

    for batch in batches:
        for r in batch.itertuples():
            with local_copy(r.bin) as bin_path, local_copy(r.idx) as idx_path:
                shard = Shard(bin_path, idx_path)
                for at in range(0, len(shard), 10_000):
                    ks = range(at, min(at + 10_000, len(shard)))
                    yield pd.DataFrame({
                        "doc_id": pd.array([shard.ids[k] for k in ks], dtype="Int64"),
                        "start": [r.base + int(shard.offsets[k]) for k in ks],
                        "n_tokens": [len(shard[k]) for k in ks],
                        "ids_crc32": [zlib.crc32(shard[k].astype("<u4").tobytes()) for k in ks],
                    })


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that ``manifest`` lists."""
    shards = max(1, manifest.count())
    return manifest.repartition(shards).mapInPandas(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    return read_token_files(spark, write_token_files(spark, docs, vocabulary=vocabulary, end_id=end_id))
