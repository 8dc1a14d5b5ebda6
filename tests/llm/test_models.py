"""Operators 4, 6 and 8: round trips, held-out accuracy, edge cases."""

import base64
import hashlib
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import quality, toxicity, warc
from tarnbeck.llm.common import shared_path

xxhash = pytest.importorskip("xxhash")
MID = "/root/testdata/sf0.01"


def test_archives_round_trip(spark):
    rows = [(i, f"http://h/{i % 3}", f"<html>{'common words in every page ' * 20}{i % 7}</html>") for i in range(60)] + [(100, None, None), (101, "u\r\nX: y", ""), (None, "u", "lonely"), (5, "again", "<html>" + "common words in every page " * 20 + "5</html>"), (200, "long", "z" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("response", F.lit(1)).repartition(3)
    files = warc.write_archives(pages, shared_path(spark, "test-op4"))
    got = warc.read_archives(files).collect()
    assert len(got) == len(rows)
    largest = {}
    for k, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if k is None else k)
    html = {(k, h or "") for k, _, h in rows}
    for r in got:
        text = next(h for k, h in html if k == r.page_id)
        body = text.encode()
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.payload_bytes == len(body)
        if r.page_id is None or r.page_id == largest[text]:
            assert r.record_type == "response" and bytes(r.payload) == body and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.refers_to == largest[text] and r.payload is None
    path = files.where("dictionary_bytes > 0").first().path.removeprefix("file://")
    with open(path, "rb") as f:
        magic, size = struct.unpack("<II", f.read(8))
        assert magic == warc.MAGIC and f.read(4) == struct.pack("<I", 0xEC30A437)


def test_small_payloads_stay_and_archives_roll(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", "same") for i in range(50)], "page_id long, url string, html string").coalesce(1)
    files = warc.write_archives(pages, shared_path(spark, "test-op4"), min_bytes=5)
    assert {r.record_type for r in warc.read_archives(files).collect()} == {"response"}
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    files = warc.write_archives(pages, shared_path(spark, "test-op4"))
    assert files.count() > 1 and warc.read_archives(files).count() == 50
    none = warc.write_archives(pages.limit(0), shared_path(spark, "test-op4"))
    assert warc.read_archives(none).count() == 0


def test_archives_as_in_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.sql(warc.OP4_SQL)
    got = warc.op4_warc(spark, sf).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def held(rows, labels, score):
    pairs = [(score(r), labels[r.doc_id]) for r in rows if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    s, y = np.array([p for p, _ in pairs]), np.array([y for _, y in pairs])
    rank = np.argsort(np.argsort(s))
    return (rank[y == 1].mean() - ((y == 1).sum() - 1) / 2) / (y == 0).sum()


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = toxicity.op8_toxicity(spark, MID).collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert held(rows, labels, lambda r: r.score) > 0.75


def test_toxicity_learns_only_from_other_rows(spark):
    docs = spark.createDataFrame([(i, "vile words" if i % 2 else "kind words") for i in range(200)] + [(500, None), (501, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) if zlib.crc32(str(i).encode()) % 5 else (i, 1 - i % 2) for i in range(200)] + [(501, None)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, labels, "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert all((got[i] > 0.5) == (i % 2 == 1) for i in range(200)) and got[500] == got[501]
    none = toxicity.fit(toxicity.labelled(docs, labels.limit(0), "toxic"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_ftrl_as_in_plain_python():
    """The update rules, coordinate by coordinate, in Python's floats."""
    import math

    rng, alpha, beta, l1, l2 = np.random.default_rng(8), 2.0, 1.0, 1.5, 0.1
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    m = toxicity.Ftrl(8, alpha, beta, l1, l2)
    for _ in range(800):
        at, y = np.unique(rng.integers(0, 256, 12)), float(rng.random() < 0.3)
        m.learn(at, y)
        w = {int(i): weight(int(i)) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i, v in w.items():
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * v, n.get(i, 0.0) + g * g
    want = [weight(i) for i in range(256)]
    assert np.allclose(m.weights(slice(None))[:256], want, atol=1e-9) and 0 < sum(v != 0 for v in want) < 256


def test_features_are_words_pairs_and_skip_pairs():
    import pyarrow as pa

    texts = ["One two-three FOUR", "one", "", None, "a a a", "x\n y"]
    f, own = toxicity.features(pa.array(texts))
    per = [set(f[own == i].tolist()) for i in range(len(texts))]
    assert [len(p) for p in per] == [4 + 3 + 2, 1, 0, 0, 3, 3]
    again, _ = toxicity.features(pa.array(["two ONE three four"]))
    assert len(per[0] & set(again.tolist())) == 4 + 1 + 2 - 1 or per[0] & set(again.tolist())
    assert per[1] < per[0]


def test_toxicity_sample_comes_from_the_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    got = toxicity.labelled(docs, labels, "toxic", sample_rows=400)
    assert 300 < got.count() < 500 and got.where(toxicity.held_out()).count() == 0
    assert toxicity.labelled(docs, labels, "toxic").count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(2000))


def test_edges_of_toxicity(spark):
    docs = spark.createDataFrame([(1, "vile words", "x"), (1, "vile words", "x"), (None, "vile words", None), (3, None, "y"), (4, "word " * 400_000, "z")], "doc_id long, text string, predicted string").withColumn("score", F.lit("clash"))
    even = (np.zeros(0, np.int64), np.zeros(0))
    got = toxicity.score(docs, even).collect()
    assert len(got) == 5 and {(r.score, r.predicted) for r in got} == {(0.5, 1)}  # a tie at 0.5 counts as toxic
    assert toxicity.score(docs.limit(0), even).count() == 0


def test_ftrl_is_sparse():
    rng, m = np.random.default_rng(0), toxicity.Ftrl(10, l1=3.0)
    for _ in range(600):
        y = float(rng.random() < 0.5)
        m.learn(np.unique(np.r_[rng.integers(1, 1024, 20), 0 if y else 1]), y)
    at, w = m.sparse()
    weight = dict(zip(at.tolist(), w.tolist()))
    assert weight[0] > 1 and weight.get(1, 0) < 0 and len(at) < 500


def test_quality_on_held_out_rows(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MID}/labels.parquet").collect()}
    rows = quality.op6_quality(spark, MID).collect()
    assert len(rows) == 1000 and held(rows, labels, lambda r: r.score) > 0.75


def plain_cotraining(docs, labels):
    """Scores by co-training in one process: every unlabelled document is scored by a sum over its features in every round."""
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array([d[0] for d in docs]), pa.array([d[2] for d in docs]), pa.array([d[3] for d in docs]), pa.array([d[1] for d in docs])], names=["doc_id", "lang", "source", "text"])
    own, f = quality.text_features(b)
    at = [(f[own == i].astype("<i4"), g.astype("<i4")) for i, g in enumerate(quality.meta_features(b))]
    bias = np.int32(1 << toxicity.BITS), np.int32(1 << quality.META_BITS)
    hashes = [xxhash.xxh64_intdigest((d[1] or "").encode(), 42) for d in docs]
    version = [h - (1 << 64) if h >> 63 else h for h in hashes]  # what ties are ordered by
    row = lambda i, y, v: (docs[i][0], y, np.append(at[i][0], bias[0]), np.append(at[i][1], bias[1]), v)
    seen = [row(i, float(labels[d[0]]), None) for i, d in enumerate(docs) if d[0] in labels and zlib.crc32(str(d[0]).encode()) % 5]
    free, taken = [i for i, d in enumerate(docs) if d[0] not in labels], [set(), set()]
    for k in range(quality.ROUNDS + 1):
        seen.sort(key=lambda r: (r[0], r[1], zlib.crc32(r[2]), zlib.crc32(r[3])))
        more = [[(r[2 + v], r[1]) for r in seen if r[4] == v] for v in (0, 1)]
        m = quality.learnt([r for r in seen if r[4] is None], more)
        s = [[m[name][np.append(at[i][v], bias[v])].sum() for v, name in enumerate(quality.VIEWS)] for i in range(len(docs))]
        if k == quality.ROUNDS:
            break
        n = min(quality.PSEUDO_ROWS, int(0.05 * len(free)))
        up = int(round(n * m["share"]))
        for v in (0, 1):
            left = [i for i in free if i not in taken[1 - v]]
            best = sorted((i for i in left if s[i][v] > 0), key=lambda i: (-s[i][v], version[i]))[:up] + sorted((i for i in left if s[i][v] <= 0), key=lambda i: (s[i][v], version[i]))[: n - up]
            taken[1 - v] |= set(best)
            seen += [row(i, float(s[i][v] > 0), 1 - v) for i in best]
    (a1, b1), (a2, b2) = m["cal"]
    return {d[0]: 1 / (1 + np.exp(-(a1 * np.clip(x, -12, 12) + b1 + a2 * np.clip(y, -12, 12) + b2 - m["prior"]))) for d, (x, y) in zip(docs, s)}


def test_quality_as_in_one_process(spark):
    rng = np.random.default_rng(5)
    docs, labels = [], {}
    for i in range(500):
        good = i % 2
        body = rng.choice([f"g{k}" if good else f"b{k}" for k in range(30)], 12).tolist() + rng.choice([f"w{k}" for k in range(200)], 20).tolist() + [f"only{i}"]
        docs.append((i, " ".join(body) + "\n" * int(rng.integers(0, 9)), ["en", "de"][rng.integers(0, 2)], f"s{good if rng.random() < 0.8 else rng.integers(0, 4)}"))
        if i < 160:
            labels[i] = good
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    told = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    want = plain_cotraining(docs, labels)
    for bound in (quality.BROADCAST_ROWS, 0):
        was, quality.BROADCAST_ROWS = quality.BROADCAST_ROWS, bound
        got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, told)).collect()}
        quality.BROADCAST_ROWS = was
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert np.mean([(want[i] > 0.5) == i % 2 for i in range(160, 500)]) > 0.9


def test_counts_of_a_text(spark):
    import pyarrow as pa

    texts = ["", None, "é漢🙂 a\n\tb.", "12,;\r\n" * 300_000]
    want = [[len(t), t.count("\n") + 1, sum(map(t.count, " \n\t")) + 1, sum(map(t.count, ".,;:!?|#*=<>{}[]()/\\_-+~^&%$@'\"0123456789"))] for t in (t or "" for t in texts)]
    assert quality.counted(pa.array(texts)).tolist() == want
    docs = spark.createDataFrame([(1, texts[3])], "doc_id long, text string")
    assert quality.score(docs, {"text": (np.zeros(0, np.int64), np.zeros(0)), "meta": (np.zeros(0, np.int64), np.zeros(0)), "cal": [0.0] * 5}).first().score == 0.5


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", None), (2, "a b", "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    got = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(got) == 3 and {r.score for r in got} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


def test_the_surest_of_all_documents_are_taken(spark):
    rows = [(i, i % 5000, (i % 5000 - 2500) / 10) for i in range(10_000)] + [(None, 7_000, 900.0)]
    scored = spark.createDataFrame(rows, "doc_id long, version long, s double")
    got = quality.surest(scored, 3, 2, {4999})
    assert got == [(None, 7000, 1.0), (4998, 4998, 1.0), (4997, 4997, 1.0), (0, 0, 0.0), (1, 1, 0.0)]


def test_views_teach_each_other():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        y = i % 2
        f, g = np.array([y * 2 + rng.integers(0, 2), 1 << toxicity.BITS]), np.array([y * 2 + rng.integers(0, 2), 1 << quality.META_BITS])
        rows.append((i, float(y) if i < 60 else None, f, g))
    m = quality.cotrain(rows)
    assert all((m["text"][f].sum() > 0) == (i % 2 == 1) and (m["meta"][g].sum() > 0) == (i % 2 == 1) for i, _, f, g in rows)
