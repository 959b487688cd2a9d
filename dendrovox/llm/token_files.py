"""Operator 4: token ids as Parquet list columns that can be read selectively.

Format: one directory of Parquet files in ascending doc_id order, columns ``doc_id, shard, start_in_shard,
n_tokens, ids``. Row groups have a bounded size, ``ids`` is dictionary-encoded (the ids of a row group are
few), the sorted number columns are delta-encoded (format version 2, no dictionary), and pages hold a bounded
number of rows, so the column and page indexes let a reader take some documents' ids, or the metadata
without any ids.

Documents are dealt by range of doc_id (rows of one doc_id may be dealt to several ranges), sorted, and encoded
in that order in one pass, which also numbers the tokens within the shard. A document's global start is its
shard's start plus that number; only one total per shard is gathered for it. ``docs_per_file`` sets how many files there are.

Cases: a null text is empty and has only the end id; repeated rows are documents of their own, in any order
among equals; an empty table gives an empty directory of the same schema; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dendrovox.llm.common import slices, table
from dendrovox.llm.pieces import PieceTable, one_by_one
from dendrovox.plans.iterate import new_path

TOKENIZER, END_ID = public_tokenizers.path("byte_bpe_50k.json"), 2
#: Documents in a file, about.
DOCS_PER_FILE = 4096
#: Pieces that a worker remembers: a bound on memory only.
TABLE = 1_000_000
SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens int, ids array<int>"
OPTIONS = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.row.count.limit": "512",
    "parquet.page.size": str(128 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start_in_shard": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in byte-level files: visible Latin-1 stands for itself, the rest is numbered from 256."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(1)
def tokenizer_table(path: str) -> PieceTable:
    """Encodes with the model of a byte-level BPE file of the ``tokenizers`` library. A Python worker keeps it from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism; its threads cost memory
    from tokenizers import Tokenizer

    merged, spell = Tokenizer.from_file(path).model.tokenize, byte_alphabet()
    return PieceTable(one_by_one(lambda piece: [t.id for t in merged(piece.encode().decode("latin-1").translate(spell))]), TABLE)


@lru_cache(1)
def added_tokens(path: str) -> dict[str, int]:
    """The tokens that the file adds to its model, which the library cuts out of a text before it is split."""
    with open(path) as file:
        found = json.load(file).get("added_tokens") or []
    if odd := [t["content"] for t in found if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]:
        raise ValueError(f"added tokens that take in what is around them are not supported: {odd}")
    return {t["content"]: t["id"] for t in found}


def encode_texts(pieces: PieceTable, texts: list[str | None], added: dict[str, int]) -> Iterator[np.ndarray]:
    """The ids of each text, null as empty: added tokens by their ids (leftmost first, of those the longest), what is between by its pieces."""
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    split = [cut.split(t) if cut and t and cut.search(t) else [t] for t in texts]  # text, token, text, ...
    ids = (found for found, _, _ in pieces.documents([t for parts in split for t in parts[::2]]))
    for parts in split:
        out = [next(ids)]
        for token in parts[1::2]:
            out += [np.array([added[token]], np.uint32), next(ids)]
        yield out[0] if len(out) == 1 else np.concatenate(out)


def write_token_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, docs_per_file: int = DOCS_PER_FILE, special_text: bool = False) -> DataFrame:
    """Write the ids of ``docs`` (``doc_id, text``) to ``path`` and return the table read back from there.

    ``special_text``: strings like those of the file's added tokens are ordinary text; else they are those tokens, as the library has it.
    """
    spark, files = docs.sparkSession, max(1, docs.count() // docs_per_file)
    added = {} if special_text else added_tokens(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, shard, start = tokenizer_table(tokenizer), TaskContext.get().partitionId(), 0
        for b in slices(batches):
            each = [np.append(ids, end_id).astype(np.int32) for ids in encode_texts(pieces, b["text"].to_pylist(), added)]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            ends = np.cumsum(sizes)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(np.full(len(each), shard, np.int32)), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int32)), ids],
                ["doc_id", "shard", "start_in_shard", "n_tokens", "ids"],
            )
            start += int(ends[-1])

    # what follows doc_id only splits one that very many rows have
    dealt = docs.select("doc_id", "text").repartitionByRange(files, "doc_id", F.xxhash64("text"), F.monotonically_increasing_id()).sortWithinPartitions("doc_id")
    dealt.mapInArrow(run, SCHEMA).write.options(**OPTIONS).parquet(path)
    return read_token_files(spark, path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' table; select without ``ids`` to read metadata only."""
    return spark.read.schema(SCHEMA).parquet(path)


def document_starts(files: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``rows`` (``shard, start_in_shard`` and others; ``files`` itself if None) with ``start``, the ids of all documents before.

    The totals read ``shard, n_tokens`` of ``files`` only.
    """
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("t"))  # a row for each file
    before = totals.select("shard", (F.sum("t").over(Window.orderBy("shard")) - F.col("t")).alias("before"))
    return (files if rows is None else rows).join(before, "shard").withColumn("start", F.col("before") + F.col("start_in_shard")).drop("before")


def ids_checksum(files: DataFrame) -> DataFrame:
    """``doc_id, shard, start_in_shard, n_tokens, ids_crc32`` (of little-endian unsigned 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            offsets, flat = b["ids"].offsets.to_numpy(), b["ids"].values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("doc_id", "shard", "start_in_shard", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, shard int, start_in_shard long, n_tokens int, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), new_path(spark, "token-files"))
    summed = document_starts(files.select("shard", "n_tokens"), ids_checksum(files))
    return summed.select("doc_id", "start", F.col("n_tokens").cast("long").alias("n_tokens"), "ids_crc32")
