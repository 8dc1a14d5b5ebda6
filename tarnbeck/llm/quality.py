"""Operator 6, quality by co-training.

Two views of a document are classified apart: its content (hashed words, word pairs and skip pairs) and its metadata
(language, source, length class, lines, share of long lines and of signs, as hashed tokens). Both start from the labelled
rows of a bounded sample; in each round, both score all unlabelled documents in one pass, and each gives the texts that it is
surest of, in the classes' proportion, to the other as pseudo-labels. Both are then calibrated (Platt) on labelled rows that neither has learnt from,
and their log-odds are combined over all documents.

Null or empty texts are scored like others, by their metadata; null labels are left out; without labelled rows of both
classes every score is the prior, 0.5. Repeated rows each get their row. Columns called p_text, p_meta, score or keep are
replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, lean, slices, small, table, texts_of, written
from .toxicity import BITS, Ftrl, features, sampled

#: Labelled rows that learning sees at most (in expectation; chosen by a hash of the key), pseudo-labels that a view gives in
#: a round at most (the surest of all unlabelled documents), labels that are broadcast at most, and rounds.
LABELLED_ROWS, PSEUDO_ROWS, BROADCAST_ROWS, ROUNDS = 8_000, 500, 2_000_000, 4
META_BITS = 16
#: Signs and digits.
SIGNS = np.isin(np.arange(256), list(b".,;:!?|#*=<>{}[]()/\\_-+~^&%$@'\"0123456789"))
#: Whether a byte begins a code point, ends a line, ends a word, is a sign.
KINDS = np.stack([np.arange(256) & 0xC0 != 0x80, np.isin(np.arange(256), [10]), np.isin(np.arange(256), [32, 10, 9]), SIGNS], 1).astype(np.int64)
#: Documents whose features are made at a time, and bytes that are counted at a time.
SLICE, WINDOW = 200, 1 << 20


def viewed(docs: DataFrame, *keep: Column) -> DataFrame:
    """(doc_id, lang, source, text, those of keep); what a table lacks is null, a null text is empty."""
    own = [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]
    return docs.select("doc_id", *own, F.coalesce("text", F.lit("")).alias("text"), *keep)


def counted(column: pa.Array) -> np.ndarray:
    """(code points, lines, words, signs) of each text."""
    data, offsets = texts_of(column)
    out = np.zeros((len(offsets) - 1, 256), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for lo in range(a, b, WINDOW):
            out[i] += np.bincount(data[lo : min(b, lo + WINDOW)], minlength=256)
    return out @ KINDS + [0, 1, 1, 0]


def text_features(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text, distinct feature) of a batch of viewed() rows."""
    f, own = features(b.column(3))
    code = np.unique(own << (BITS + 1) | f)
    return code >> (BITS + 1), code & ((1 << (BITS + 1)) - 1)


def meta_features(b: pa.RecordBatch) -> np.ndarray:
    """One row of feature numbers per document."""
    out = np.empty((b.num_rows, 8), np.int64)
    for i, (a, s, (c, n, w, g)) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), counted(b.column(3)).tolist(), strict=True)):
        size, line, word, sign = int(2 * np.log2(c + 1)), int(2 * np.log2(c / n + 1)), int(4 * np.log2(c / w + 1)), int(40 * g / (c + 1))
        for j, x in enumerate((f"l{a}", f"s{s}", f"c{size}", f"n{line}", f"w{word}", f"g{sign}", f"c{size}n{line}", f"g{sign}w{word}")):
            out[i, j] = _token(x)
    return out


def view_margins(b: pa.RecordBatch, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both views' margins of a batch of viewed() rows under dense weights."""
    f, own = features(b.column(3))
    hit = np.flatnonzero(text[f])
    code = np.unique(own[hit] << (BITS + 1) | f[hit])
    s = np.bincount(code >> (BITS + 1), weights=text[code & ((1 << (BITS + 1)) - 1)], minlength=b.num_rows) + text[1 << BITS]
    return s, meta[meta_features(b)].sum(axis=1) + meta[1 << META_BITS]


def dense(model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The weights of both views."""
    out = np.zeros((1 << BITS) + 1), np.zeros((1 << META_BITS) + 1)
    for w, name in zip(out, VIEWS, strict=True):
        w[model[name][0]] = model[name][1]
    return out


_TOKENS: dict[str, int] = {}


def _token(x: str) -> int:
    if x not in _TOKENS:
        if len(_TOKENS) > 100_000:
            _TOKENS.clear()
        _TOKENS[x] = zlib.crc32(x.encode()) & ((1 << META_BITS) - 1)
    return _TOKENS[x]


#: Margins beyond this count as this.
MARGIN = 12.0


def _margin(s: np.ndarray) -> np.ndarray:
    return np.clip(s, -MARGIN, MARGIN)


def _trained(rows: list[tuple[np.ndarray, float]], bits: int, seed: int, passes: int = 4) -> np.ndarray:
    model, order = Ftrl(bits, alpha=1.0, l1=2.0), np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            model.learn(rows[i][0], rows[i][1])
    return model.weights(slice(None))


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that a * s + b are log-odds; smoothed targets, Newton steps."""
    lo, hi = 1 / ((y == 0).sum() + 2), ((y == 1).sum() + 1) / ((y == 1).sum() + 2)
    t, x, v = np.where(y == 1, hi, lo), np.c_[s, np.ones(len(s))], np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (p - t) + 1e-2 * (v - [1, 0]))
        v = v - step * min(1.0, 0.5 / max(1e-9, np.abs(step).max()))
    return float(max(v[0], 0.0)), float(v[1])


def cotrain(rows: list[tuple[int, float | None, np.ndarray, np.ndarray]], rounds: int = ROUNDS, given: float = 0.05, seed: int = 0) -> dict:
    """rows: (key, label or None, text features, metadata features), each with its bias. Weights and calibration of both views."""
    known, free = [r for r in rows if r[1] is not None], [r for r in rows if r[1] is None]
    more: list[list[tuple[np.ndarray, float]]] = [[], []]
    taken: list[set[int]] = [set(), set()]
    for k in range(rounds + 1):
        m = learnt(known, more, seed)
        if k == rounds or not free or m["share"] is None:
            break
        for v, name in enumerate(VIEWS):
            s = np.array([m[name][r[2 + v]].sum() for r in free])
            order = [i for i in np.argsort(-s, kind="stable") if i not in taken[1 - v]]
            n = int(given * len(free))
            up, down = int(round(n * m["share"])), n - int(round(n * m["share"]))
            for i, label in [*((i, 1.0) for i in order[:up]), *((i, 0.0) for i in order[len(order) - down :])]:
                if (s[i] > 0) == (label > 0):
                    taken[1 - v].add(i)
                    more[1 - v].append((free[i][3 - v], label))
    return m


VIEWS = ("text", "meta")


def learnt(known: list[tuple[int, float, np.ndarray, np.ndarray]], more: list[list[tuple[np.ndarray, float]]], seed: int = 0) -> dict:
    """Weights and calibration of both views from labelled rows and each view's pseudo-labelled ones; share: of positive labels, None without both classes."""
    aside, own = known[::5], [r for i, r in enumerate(known) if i % 5]
    if len({r[1] for r in own}) < 2 or len({r[1] for r in aside}) < 2:
        return {"text": np.zeros((1 << BITS) + 1), "meta": np.zeros((1 << META_BITS) + 1), "cal": ((0.0, 0.0), (0.0, 0.0)), "prior": 0.0, "share": None}
    share = float(np.mean([r[1] for r in own]))
    w = [_trained([(r[2 + v], r[1]) for r in own] + more[v], bits, seed) for v, bits in enumerate((BITS, META_BITS))]
    y = np.array([r[1] for r in aside])
    cal = tuple(_platt(_margin(np.array([w[v][r[2 + v]].sum() for r in aside])), y) for v in (0, 1))
    return {"text": w[0], "meta": w[1], "cal": cal, "prior": float(np.log(share / (1 - share))), "share": share}


def version() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, text features, metadata features, view that learns from it or null) of viewed() rows with label and view."""
    for b in slices(batches, 3, SLICE):
        own, f = text_features(b)
        cuts, f, meta = np.searchsorted(own, np.arange(b.num_rows + 1)), f.astype("<i4"), meta_features(b).astype("<i4")
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), pa.array([f[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary()), b.column(5)], names=["doc_id", "label", "f", "g", "view"])


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, more = [], [[], []]
    for b in batches:
        for k, y, f, g, v in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            seen.append((k or 0, y, np.append(np.frombuffer(f, "<i4"), np.int32(1 << BITS)), np.append(np.frombuffer(g, "<i4"), np.int32(1 << META_BITS)), v))
    seen.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2]), zlib.crc32(r[3])))
    for r in seen:
        if r[4] is not None:
            more[r[4]].append((r[2 + r[4]], r[1]))
    m = learnt([r for r in seen if r[4] is None], more)
    out = []
    for v in VIEWS:
        at = np.flatnonzero(m[v])
        out += [pa.array([at.astype("<i8").tobytes()]), pa.array([m[v][at].astype("<f8").tobytes()])]
    yield pa.RecordBatch.from_arrays([*out, pa.array([[*m["cal"][0], *m["cal"][1], m["prior"]]], pa.list_(pa.float64())), pa.array([m["share"]], pa.float64())], names=["ta", "tw", "ma", "mw", "cal", "share"])


def margins(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(doc_id, version, s_text, s_meta): both views' margins of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dense(sent.value)
        for b in slices(batches, 3, SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), *map(pa.array, view_margins(b, *w))], names=["doc_id", "version", "s_text", "s_meta"])

    return viewed(docs, version().alias("version")).mapInArrow(lean(run), "doc_id long, version long, s_text double, s_meta double")


def surest(scored: DataFrame, up: int, down: int, taken: set[int]) -> list[tuple[int | None, int, float]]:
    """(doc_id, version, label) of the texts with the largest and the least margins s, copies once, without those taken (versions).

    Every task keeps its own surest versions, so few rows are shuffled however large the table is.
    """
    limits = (up + len(taken), down + len(taken))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("s", "f8"), ("version", "i8"), ("nul", "?"), ("id", "i8")])
        held = [np.zeros(0, kind), np.zeros(0, kind)]
        for b in batches:
            rows = np.zeros(b.num_rows, kind)
            rows["s"], rows["version"] = b.column(2).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            rows["nul"], rows["id"] = b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for side, sign in enumerate((-1, 1)):
                x = rows[rows["s"] > 0] if side == 0 else rows[rows["s"] <= 0]
                x = np.concatenate([held[side], x])
                x = x[np.lexsort((x["id"], x["nul"], x["version"], sign * x["s"]))]
                x = x[np.sort(np.unique(x["version"], return_index=True)[1])]
                held[side] = x[: limits[side]]
        side = np.repeat(np.arange(2, dtype=np.int32), [len(x) for x in held])
        x = np.concatenate(held)
        yield pa.RecordBatch.from_arrays([pa.array(side), pa.array(np.where(x["nul"], 0, x["id"]), mask=x["nul"]), pa.array(x["version"]), pa.array(x["s"])], names=["side", "doc_id", "version", "s"])

    key = F.struct(F.when(F.col("side") == 0, -F.col("s")).otherwise(F.col("s")).alias("s"), F.col("doc_id").isNull().alias("nul"), "doc_id")
    kept = scored.select("doc_id", "version", "s").mapInArrow(best, "side int, doc_id long, version long, s double")
    once = written(kept.groupBy("side", "version").agg(F.min(key).alias("k")).select("side", "version", "k.s", "k.doc_id"), "surest")
    out = []
    for side, (n, label) in enumerate(((up, 1.0), (down, 0.0))):
        rows = once.where(F.col("side") == side).orderBy("s", "version").limit(limits[side]).collect()
        out += [(r.doc_id, r.version, label) for r in rows if r.version not in taken][:n]
    return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled_rows: int = LABELLED_ROWS, pseudo_rows: int = PSEUDO_ROWS, given: float = 0.05) -> dict:
    """The model, with sparse weights, from documents and labels (doc_id, column)."""
    spark = docs.sparkSession
    named = labels.select("doc_id", F.col(column).cast("double").alias("label")).where("label is not null")
    known = named.where(~held_out())
    none, shape = F.lit(None).cast("int").alias("view"), "doc_id long, label double, f binary, g binary, view int"
    chosen = written(sampled(known, 1, labelled_rows, F.lit(7), "doc_id"), "quality-labels")
    rows = viewed(docs).join(small(chosen, 2 * labelled_rows), "doc_id").select("*", none)
    feats = written(rows.mapInArrow(gather, shape), "quality-rows")
    labelled = written(named.select("doc_id").distinct(), "labelled")
    few = labelled.count() <= BROADCAST_ROWS
    n, taken = None, [set(), set()]
    for k in range(ROUNDS + 1):
        r = feats.repartition(1).mapInArrow(lean(train), "ta binary, tw binary, ma binary, mw binary, cal array<double>, share double").first()
        if r is None:
            return {"text": (np.zeros(0, np.int64), np.zeros(0)), "meta": (np.zeros(0, np.int64), np.zeros(0)), "cal": [0.0] * 5}
        m = {"text": (np.frombuffer(r.ta, "<i8"), np.frombuffer(r.tw, "<f8")), "meta": (np.frombuffer(r.ma, "<i8"), np.frombuffer(r.mw, "<f8")), "cal": list(r.cal)}
        if k == ROUNDS or r.share is None:
            return m
        sent = spark.sparkContext.broadcast(m)
        # labels too many to send along meet the margins and not the texts
        free = margins(docs.join(F.broadcast(labelled), "doc_id", "left_anti"), sent) if few else margins(docs, sent).join(labelled, "doc_id", "left_anti")
        free = written(free, "margins")
        sent.destroy()
        if n is None:
            n = min(pseudo_rows, int(given * free.count()))
            up = int(round(n * r.share))
        new = []
        for v, name in enumerate(VIEWS):
            got = surest(free.withColumn("s", F.col(f"s_{name}")), up, n - up, taken[1 - v])
            taken[1 - v] |= {x[1] for x in got}
            new += [(*x, 1 - v) for x in got]
        if new:
            told = F.broadcast(spark.createDataFrame(new, "__own long, __told long, __label double, __view int"))
            same = F.col("doc_id").eqNullSafe(F.col("__own")) & (F.col("__version") == F.col("__told"))
            hit = docs.withColumn("__version", version()).join(told, same).select(*docs.columns, "__label", "__view")
            once = hit.dropDuplicates(["doc_id", "text", "__view"])
            feats = feats.unionByName(written(viewed(once, F.col("__label").alias("label"), F.col("__view").alias("view")).mapInArrow(gather, shape), "quality-pseudo"))


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) for every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dense(sent.value)
        a1, b1, a2, b2, prior = sent.value["cal"]
        prob = lambda s: 1 / (1 + np.exp(-np.clip(s, -35, 35)))
        for b in slices(batches, 3, SLICE):
            s, t = view_margins(b, *w)
            s, t = a1 * _margin(s) + b1, a2 * _margin(t) + b2
            p = prob(s + t - prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prob(s)), pa.array(prob(t)), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "p_text", "p_meta", "score", "keep"])

    src = viewed(docs)
    return src.mapInArrow(lean(run), T.StructType([src.schema["doc_id"], *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")), T.StructField("keep", T.BooleanType())]))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
