"""The pipeline against plain Python on a small corpus, and its decisions on the driver's tables."""

import random
import re

import corpus_pipeline
from tarnbeck.llm.common import table

P = __import__("pytest").importorskip("public_tokenizers")
VILE = ("idiot", "moron", "scum", "trash")


def corpus(rng):
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(n))
    item = "the hidden benchmark question has rather more than thirteen words in a row to be found by seeds"
    docs = []
    for _ in range(60):
        docs.append(prose(40))
    for _ in range(40):
        docs.append(prose(20) + " " + " ".join(rng.choices(VILE, k=20)))
    base = prose(120)
    docs += [base, base, base + " tail", prose(30) + " " + item + " " + prose(30), prose(20) + " mail me@here.example now " + prose(20), "", None]
    rng.shuffle(docs)
    return list(enumerate(docs)), [(1, item)]


def test_decisions(spark, tmp_path):
    rng = random.Random(4)
    docs, items = corpus(rng)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    vile = {k for k, t in docs if t and any(v in t.split() for v in VILE)}
    spark.createDataFrame([(k, 1, int(k in vile)) for k, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if (t or "").split() else set()
    kept = {}
    for k, t in docs:
        s = shingles(t)
        if k in vile or items[0][1] in (t or "") or any(s and u and 100 * len(s & u) >= 75 * len(s | u) for u in map(shingles, kept.values())):
            continue
        kept[k] = t
    assert set(got) == set(kept)
    for k, t in kept.items():
        want = re.sub(r"\S+@here\.example", "[EMAIL]", t or "")
        assert got[k].decoded == sp.decode(sp.encode(want)) and got[k].ids == sp.encode(want) and got[k].n_chars == len(want)


def test_stages_keep_their_columns(spark, sf):
    docs = table(spark, sf, "documents").limit(40)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.count() <= 40, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "sentencepiece"]


def tables(spark, path, docs, items, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_empty_tables(spark, tmp_path):
    tables(spark, tmp_path, [], [], [])
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "ids", "decoded"} <= set(got.columns)


def test_null_keys_and_no_labels(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(60))
    docs = [(None, base, None, None, None), (None, base, "en", "s", 5), (None, base + " more", "en", "s", 5), (7, base, "en", "s", 5), (8, None, None, None, None), (8, "", "en", "s", 0), (None, None, None, None, None)]
    tables(spark, tmp_path, docs, [(None, None), (1, "")], [(None, None, None), (7, None, None)])
    # without labels nothing is learnt and nothing is rejected; one of the copies stays, and texts without words
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.decoded) for r in got if r.doc_id is not None) == [(7, base), (8, "")]
    assert [r.decoded for r in got if r.doc_id is None] == [""]
    # one class alone teaches nothing either
    tables(spark, tmp_path / "one", docs, [(1, "")], [(i, 1, 1) for i in range(12)])
    assert corpus_pipeline.reject_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), f"{tmp_path}/one").count() == len(docs)
    tables(spark, tmp_path / "b", docs, [(None, None), (1, "")], [(i, 0, i % 2) for i in range(100, 300)])
    import os

    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        kept = stage(spark, kept, str(tmp_path / "b"))
    rows = {(r.doc_id, r.decoded) for r in kept.collect()}
    assert (7, base) in rows and len([r for r in rows if r[1]]) == 1 and (8, "") in rows and os.path.exists(tmp_path)


NAMES = "row own label score predicted version key item name node spans entities terms t id n_e groups share u v asked text_a".split()


def test_clashing_columns(spark, sf, tmp_path):
    """Extra columns called like what the operators use inside stay as they are, and results too."""
    from pyspark.sql import functions as F

    import __spark_entry__

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    wide = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})
    for path, df in (("plain", docs), ("wide", wide)):
        df.write.parquet(f"{tmp_path}/{path}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{path}/{t}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        assert out.where(F.expr(" or ".join(f"{n} <> concat('{n}', doc_id)" for n in NAMES))).isEmpty(), name
    for name in [q for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit() and q[2:4] not in ("4_", "11", "12", "13")]:
        got = [sorted(map(str, __spark_entry__.queries()[name](spark, f"{tmp_path}/{path}").collect())) for path in ("plain", "wide")]
        assert got[0] == got[1], name


def test_only_the_overlapped_text_of_a_key_goes(spark):
    from tarnbeck.llm import decontamination

    item = "the hidden benchmark question has rather more than thirteen words in a row to be found"
    docs = spark.createDataFrame([(None, item), (None, "quite another harmless text"), (2, "short"), (3, item), (3, "harmless"), (3, item)], "doc_id long, text string")
    got = decontamination.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == [(2, "short"), (3, "harmless"), (None, "quite another harmless text")]


def test_ties_and_texts_without_words_are_kept(spark, tmp_path, monkeypatch):
    import numpy as np

    from tarnbeck.llm import toxicity

    docs = spark.createDataFrame([(1, "a word", 7.0), (2, "", 8.0), (3, None, 9.0), (4, "?!", 1.0)], "doc_id long, text string, score double")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for bias, kept in ((0.0, {1, 2, 3, 4}), (5.0, {2, 3, 4})):
        monkeypatch.setattr(toxicity, "fit", lambda rows, b=bias: (np.array([1 << toxicity.BITS]), np.array([b])))
        got = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
        assert {r.doc_id for r in got.collect()} == kept and got.where("doc_id = 2").first().score == 8.0
