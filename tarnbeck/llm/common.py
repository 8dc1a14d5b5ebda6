"""Shared pieces of the text operators: tables, written stages, shared-folder files and word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbeck.operators.frames import spread
from tarnbeck.operators.staging import local_name, shared_path, shared_root, small, written  # noqa: F401

#: Bytes of text that an operator works on at a time, unless one text has more.
SLICE_BYTES = 8 << 20
#: Rows of an Arrow batch at most.
ARROW_ROWS, _BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts and pages that one row group or a few hold are dealt out over the cores, larger tables stay as they are."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


@contextlib.contextmanager
def new_file(uri: str):
    """A binary file that appears under its name only when complete; a second attempt replaces it with equal bytes."""
    path, tag = local_name(uri), f".{uuid.uuid4().hex}.tmp"
    if path is None:
        store, path = _store(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path + tag) as f:
            yield f
        if store.get_file_info(path).is_file:  # of an earlier attempt; not every store moves onto a name that exists
            store.delete_file(path)
        store.move(path + tag, path)
    else:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path + tag, "wb") as f:
            yield f
        os.replace(path + tag, path)


def open_file(uri: str):
    path = local_name(uri)
    if path is not None:
        return open(path, "rb")
    store, path = _store(uri)
    return store.open_input_stream(path)


def _store(uri: str):
    """(file system, path) of a URI; Hadoop's names of S3 are pyarrow's s3."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"s3{sep}{rest}" if scheme in ("s3a", "s3n") else uri)


def lean(run):
    """run, a function from batches to batches, that gives freed memory back when a task ends: workers live on between tasks.

    Sets the session's Arrow batches to ARROW_ROWS rows at most: a batch of texts is held by the JVM and by the worker, and of
    ten thousand rows it is tens of megabytes on either side.
    """
    session = SparkSession.getActiveSession()
    if session is not None and not 0 < int(session.conf.get(_BATCH)) <= ARROW_ROWS:
        session.conf.set(_BATCH, ARROW_ROWS)

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return ran


def trim() -> None:
    """Gives freed memory of this process back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int | str, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and, unless it is one row, so many bytes in the column `text`; nulls have none."""
    for whole in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < whole.num_rows:
            fit = int(np.searchsorted(ends, size + (ends[lo - 1] if lo else 0), side="right"))
            hi = min(max(fit, lo + 1), lo + rows, whole.num_rows)
            yield whole.slice(lo, hi - lo)
            lo = hi


def held_out() -> F.Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def edge_table(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): for each end of edges (u, v), the smallest node that it is connected with.

    Alternating large-star and small-star steps; each round is a written table, the rounds grow with the logarithm of
    the longest chain. A node with very many links only ever meets in partial minima and in a join that adaptive
    execution can split. Empty edges: no rows. Nulls on either side: no link.
    """
    cur = written(edge_table(edges.where("u is not null and v is not null")), "edges")
    for _ in range(rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        nxt = written(small, "edges")
        was, now = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (cur, nxt))
        cur = nxt
        if was == now:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# ---- word hashing over Arrow buffers -------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and every other ASCII sign that is neither letter nor digit.
SIGNS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = 1 << 20


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _STEP, np.uint64)])


_POW = _powers(_WINDOW)
_INV = np.multiply.accumulate(np.r_[np.uint64(1), np.full(_WINDOW, np.uint64(pow(int(_STEP), -1, 2**64)), np.uint64)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word): words are runs of bytes not marked in space, A-Z folded.

    Works through windows of a megabyte, so memory does not depend on how long one text is; a word that is cut by a
    window is put together again from the parts' polynomial sums.
    """
    out, counts = [], np.zeros(len(offsets), np.int64)
    cuts = np.zeros(len(data) + 1, bool)
    cuts[offsets] = True
    carry, at = np.uint64(0), 0  # polynomial sum and length of the word that the last window left open
    starts_at = []
    for lo in range(0, len(data), _WINDOW):
        d = data[lo : lo + _WINDOW]
        word = ~space[d]
        first = word & np.r_[True, ~word[:-1]]
        first |= word & cuts[lo : lo + len(d)]
        s = np.flatnonzero(first)
        last = word & np.r_[~word[1:] | cuts[lo + 1 : lo + len(d)], True]
        e = np.flatnonzero(last) + 1
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[d] * _POW[: len(d)], dtype=np.uint64)]
        h = (sums[e] - sums[s]) * _INV[s]
        begin = s + lo
        if at and len(d):
            if word[0] and not cuts[lo]:
                h[0] = (int(carry) + int(h[0]) * pow(int(_STEP), at, 2**64)) % 2**64
                at, begin = at + int(e[0]), begin[1:]
                if len(e) == 1 and e[0] == len(d) and lo + len(d) < len(data) and not cuts[lo + len(d)]:
                    carry = h[0]
                    continue
                out.append(h[:1])
                h, s, e = h[1:], s[1:], e[1:]
            else:
                out.append(np.array([carry], np.uint64))
            at, carry = 0, np.uint64(0)
        starts_at.append(begin)
        if len(e) and e[-1] == len(d) and lo + len(d) < len(data) and not cuts[lo + len(d)]:
            carry, at = h[-1], int(e[-1] - s[-1])
            h = h[:-1]
        out.append(h)
    if at:
        out.append(np.array([carry], np.uint64))
    begins = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return mix(np.concatenate(out) if out else np.zeros(0, np.uint64)), np.searchsorted(begins, offsets, side="left")


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    words, first = word_hashes(*texts_of(column))
    with np.errstate(over="ignore"):
        n = max(0, len(words) - k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams += words[j : j + n] * _ODD[j]
        grams = mix(grams)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield grams[:0]
