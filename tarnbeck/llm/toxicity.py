"""Operator 8, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, pairs of neighbouring words and pairs one word apart (words are runs
of letters and digits, A-Z folded). Learning goes through a bounded sample of labelled rows with per-coordinate rates and
L1, which leaves few weights that are not zero; those are what scoring needs, and they are small enough to send along.
The sample is drawn from the labels, by a hash of the key, before they meet the texts.
Labels, languages, sources and keys are never inputs of a score.

Empty and null texts get the score of the bias alone; null labels are left out of learning; rows that repeat each count;
without labelled rows of both classes there are no weights and every score is 0.5. Columns called like the results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SIGNS, held_out, lean, mix, slices, small, table, texts_of, word_hashes, written

BITS = 20
#: Labelled rows that learning sees at most (in expectation; chosen by a hash of the key).
SAMPLE_ROWS = 16_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each position and kind, text it belongs to); a feature may come up several times in a text."""
    w, first = word_hashes(*texts_of(column), SIGNS)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    keep = np.uint64((1 << bits) - 1)
    feats, owners = [w & keep], [own]
    for gap in (1, 2):
        same = own[:-gap] == own[gap:]
        feats.append((mix(w[:-gap] * _A + w[gap:] * _B + np.uint64(gap)) & keep)[same])
        owners.append(own[:-gap][same])
    return np.concatenate(feats).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates (McMahan et al., 2013); coordinate 2**bits is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])
        self.z[at] += g - root / self.alpha * w
        self.n[at] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        w = self.weights(slice(None))
        at = np.flatnonzero(w)
        return at, w[at]


def sampled(rows: DataFrame, slack: float, sample_rows: int, *by) -> DataFrame:
    """rows, or sample_rows of them in expectation, chosen by a hash, if there are more than slack times as many."""
    n = rows.count()
    return rows if n <= slack * sample_rows else rows.where(F.pmod(F.xxhash64(*by), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))


def fit(rows: DataFrame, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, passes: int = 8, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The weights that are not zero, from rows (doc_id, text, label) with labels 0 and 1."""
    rows = rows.where("label is not null").select("doc_id", "text", F.col("label").cast("double").alias("label"))
    rows = sampled(rows, 1.25, sample_rows, F.lit(seed + 1), "doc_id", "text")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 200):
            f, own = features(b.column(1), bits)
            code = np.unique(own << (bits + 1) | f)
            cuts = np.searchsorted(code >> (bits + 1), np.arange(b.num_rows + 1))
            f = (code & ((1 << (bits + 1)) - 1)).astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([f[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["doc_id", "label", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(k or 0, np.frombuffer(f, "<i4"), y) for b in batches for k, y, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        if len({y for _, _, y in seen}) < 2:
            return
        seen.sort(key=lambda x: (x[0], x[2], zlib.crc32(x[1])))
        model, order, bias = Ftrl(bits), np.random.default_rng(seed), np.array([1 << bits], np.int64)
        for _ in range(passes):
            for i in order.permutation(len(seen)):
                model.learn(np.r_[seen[i][1].astype(np.int64), bias], seen[i][2])
        at, w = model.sparse()
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i8").tobytes()]), pa.array([w.astype("<f8").tobytes()])], names=["at", "w"])

    got = written(rows.mapInArrow(lean(gather), "doc_id long, label double, f binary"), "ftrl-rows").repartition(1).mapInArrow(lean(train), "at binary, w binary").first()
    return (np.frombuffer(got.at, "<i8"), np.frombuffer(got.w, "<f8")) if got else (np.zeros(0, np.int64), np.zeros(0))


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", bits: int = BITS, keep_text: bool = False, names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """docs with score double and predicted int (1 if score >= 0.5), or what names calls them, in place of the text or beside it."""
    rest = [c for c in docs.columns if c not in (text, *names)] + [text] * keep_text
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = sent.value
        dense = np.zeros((1 << bits) + 1)
        dense[at] = w
        for b in slices(batches, len(rest), 200):
            f, own = features(b.column(b.num_columns - 1), bits)
            hit = np.flatnonzero(dense[f])
            code = np.unique(own[hit] << (bits + 1) | f[hit])
            s = np.bincount(code >> (bits + 1), weights=dense[code & ((1 << (bits + 1)) - 1)], minlength=b.num_rows) + dense[1 << bits]
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(rest))), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*rest, *names])

    src = docs.select(*rest, F.col(text).alias("__text"))
    schema = T.StructType([*docs.select(*rest).schema, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return src.mapInArrow(lean(run), schema)


def labelled(docs: DataFrame, labels: DataFrame, column: str, sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> DataFrame:
    """(doc_id, text, label) of a sample of the rows whose labels may be learnt from."""
    known = labels.where(~held_out()).select("doc_id", F.col(column).alias("label")).where("label is not null")
    chosen = written(sampled(known, 1, sample_rows, F.lit(seed), "doc_id"), "labels")
    return docs.select("doc_id", "text").join(small(chosen, 2 * sample_rows), "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(labelled(docs, table(spark, sf_dir, "labels"), "toxic"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
