"""Operator 5, token ids in Parquet: list columns with dictionary or delta encoding, set row groups and page indexes.

Documents are range-partitioned by key, so that file after file holds them in ascending order. Each file has the columns
key, part, local_start (ids before the document in its file), n_tokens and ids; a page index and the statistics let a reader
take a few documents' ids, or the counts alone, without the rest. Files get their name only when complete, and a second
attempt of a task writes the same bytes, so a lost executor leaves neither gaps nor doubles.

The tokenizer splits at white space and is applied to words, remembered in a table of bounded size.

Nulls count as empty texts and give the end id alone; a null key sorts first; repeated keys are ordered by a hash of the
text; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_file, shared_path, slices, table, written

#: Words that the table of one Python worker holds before it starts anew.
TABLE_SIZE = 800_000
#: Ids and documents that one row group holds at most.
GROUP_IDS, GROUP_ROWS = 4_000_000, 20_000
END = 1


class WordCodec(dict):
    """Word (UTF-8, no ASCII white space) -> its ids as little-endian int32.

    Exact where the tokenizer drops white space and treats what stands between it separately, as checked on loading.
    """

    def __init__(self, path: str, size: int = TABLE_SIZE):
        from tokenizers import Tokenizer

        self.library, self.size = Tokenizer.from_file(path), size
        probe = "it's A b.c, été\n\nx <|endoftext|> 12\tz"
        if self.library.encode(probe, add_special_tokens=False).ids != [i for w in probe.split() for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this tokenizer's ids depend on more than single words")
        from tokenizers import pre_tokenizers

        # the sign that stands for each byte in the vocabulary, as the library itself writes it
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        self.signs = {b: chr(256 + i) for i, b in enumerate(moved)}
        if any(split.pre_tokenize_str(c)[0][0] != c.encode().decode("latin-1").translate(self.signs) for c in "azéßñÿ"):
            raise ValueError("this tokenizer does not write bytes as signs")
        self.merge = self.library.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        tail = word[-1:]
        if len(word) > 1 and tail in (b".", b",") and word[-2:-1].isalpha():
            ids = self[word[:-1]] + self[tail]
        else:
            text = word.decode()
            if text.isalpha() and max(text) < "\u0250" and text.islower() and is_normalized("NFC", text):
                # one letter run that normalising leaves as it is: straight to the merges, bytes in the library's signs
                ids = array("i", [t.id for t in self.merge(word.decode("latin-1").translate(self.signs))]).tobytes()
            else:
                ids = array("i", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        # A-Z are folded by the tokenizer anyway, but in the names of its special tokens
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def trim(self) -> None:
        if len(self) > self.size:
            self.clear()


@lru_cache(2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def write_tokens(docs: DataFrame, path: str, to: str, key: str = "doc_id", text: str = "text", encoding: str = "dictionary", partitions: int | None = None) -> DataFrame:
    """Writes the token files below `to` and returns their list: part, path, n_docs, n_tokens (one row a file, written)."""
    import pyarrow.parquet as pq

    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding!r}")
    by = [F.col("k").asc_nulls_first(), F.col("h")]
    src = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    src = (src.repartitionByRange(partitions, *by) if partitions else src.repartitionByRange(*by)).sortWithinPartitions(*by).select("k", "t")
    schema = pa.schema([pa.field(key, pa.int64()), pa.field("part", pa.int32(), False), pa.field("local_start", pa.int64(), False), pa.field("n_tokens", pa.int64(), False), pa.field("ids", pa.list_(pa.int32()), False)])
    how = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": False, "column_encoding": {"ids.list.element": "DELTA_BINARY_PACKED", "local_start": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = codec(path), TaskContext.get().partitionId()
        name, n_docs, at = f"{to}/part-{part:06d}.parquet", 0, 0
        keys, ids, lens, held = [], [], [], 0
        with new_file(name) as f, pq.ParquetWriter(f, schema, compression="zstd", compression_level=1, write_page_index=True, data_page_size=256 << 10, **how) as w:

            def flush():
                nonlocal keys, ids, lens, held, at
                n = np.array(lens, np.int64)
                ends = np.cumsum(n)
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), values)
                w.write_table(pa.Table.from_arrays([pa.array(keys, pa.int64()), pa.array(np.full(len(n), part), pa.int32()), pa.array(at + ends - n), pa.array(n), lists], schema=schema), row_group_size=len(n))
                at += int(ends[-1])
                keys, ids, lens, held = [], [], [], 0

            for b in slices(batches, 1, 256):
                for k, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                    x = c.encode(t) + b"\1\0\0\0"
                    keys.append(k), ids.append(x), lens.append(len(x) // 4)
                    held += len(x) // 4
                    if held >= GROUP_IDS or len(keys) >= GROUP_ROWS:
                        n_docs += len(keys)
                        flush()
                c.trim()
            if keys:
                n_docs += len(keys)
                flush()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([at], pa.int64())], names=["part", "path", "n_docs", "n_tokens"])

    return written(src.mapInArrow(run, "part int, path string, n_docs long, n_tokens long"), "token-files")


def read_tokens(spark: SparkSession, to: str, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids): start counts the ids of all files and documents before."""
    schema = f"`{key}` long, part int, local_start long, n_tokens long, ids array<int>"
    if files.isEmpty():
        return spark.createDataFrame([], schema).select(key, F.col("local_start").alias("start"), "n_tokens", "ids")
    before = files.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("before"))
    rows = spark.read.schema(schema).parquet(to)
    return rows.join(before, "part").select(key, (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(column: pa.Array) -> pa.Array:
    ends, values = column.offsets.to_numpy(), memoryview(column.values.to_numpy(zero_copy_only=False).astype("<u4"))
    return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())


def op5_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    to = shared_path(spark, "op5")
    files = write_tokens(table(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"), to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), ids_crc32(b.column(3))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, to, files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
