"""Operators 3, 5 and 10 against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbeck.llm import piece_codec, token_counts, token_files
from tarnbeck.llm.common import shared_path

P = pytest.importorskip("public_tokenizers")
ODD = ["", None, " ", "  a  b ", "a\n\nb\n", "Ünï 漢字 🙂🙂 ́x", "▁raw ▁", "x" * 3000, "it's 12,345.67 <|endoftext|> <s></s>", "\t\r\x0b\x0c\x1c\x85 z", "a.b,c. d", "word " * 4000, "ΣΑΣ İ ﬁ ǅ", "\x00a"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    real = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)] + [(-3, ODD[2])], "doc_id long, text string")
    return real.unionByName(odd).cache()


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    got = piece_codec.encode_decode(docs.withColumn("ids", F.lit("clash")).withColumn("source_text", F.col("text")), path).collect()
    assert len(got) == docs.count() and {(r.doc_id, r.source_text) for r in got} == text
    for r in got:
        want = sp.encode(r.source_text or "")
        assert r.ids == want and r.decoded == sp.decode(want)


def test_piece_query(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in piece_codec.op10_sentencepiece(spark, sf).collect():
        ids = sp.encode(text[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())


def test_a_difference_from_the_library_raises():
    c = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    c.encode("hello there")
    c[" there"] = [5]
    c.new.append(" there")
    with pytest.raises(AssertionError):
        c.check()


def test_a_small_table_keeps_frequent_segments(monkeypatch):
    c, done = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"), 60), []
    agenda = c.agenda
    monkeypatch.setattr(c, "agenda", lambda part: done.append(part) or agenda(part))
    most = 0
    for i in range(60):
        text = f"common words\n {' '.join(f'{chr(97 + j)}rare{i * 31 + j}' for j in range(20))} common"
        assert list(memoryview(c.encode(text)).cast("i")) == c.library.encode(text)
        c.check()
        most = max(most, len(c) + len(c.old))
    assert most < 300 and done.count("▁common") == 1 and done.count("▁words") == 1


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, encoding):
    import pyarrow.parquet as pq
    import tokenizers

    tk = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    to = shared_path(spark, "test-op5")
    files = token_files.write_tokens(docs, P.path("word_bpe_49k.json"), to, encoding=encoding, partitions=3)
    rows = sorted(token_files.read_tokens(spark, to, files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    at, text = 0, {}
    for r in docs.collect():
        text.setdefault(r.doc_id, r.text)
    for r in rows:
        want = [*tk.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        at += len(want)
    meta = pq.ParquetFile(files.first().path.removeprefix("file://")).metadata
    ids = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if "ids" in meta.row_group(0).column(i).path_in_schema)
    assert ids.has_offset_index and ids.has_column_index
    assert any(("DICTIONARY" if encoding == "dictionary" else "DELTA") in e for e in ids.encodings)


def test_token_files_of_nothing(spark, docs):
    to = shared_path(spark, "test-op5")
    files = token_files.write_tokens(docs.limit(0), P.path("word_bpe_49k.json"), to)
    assert token_files.read_tokens(spark, to, files).count() == 0
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, P.path("word_bpe_49k.json"), to, encoding="plain")


def test_crc():
    import pyarrow as pa

    a = pa.array([[1, 2], [], [65535]], pa.list_(pa.int32()))
    assert token_files.ids_crc32(a).to_pylist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ([1, 2], [], [65535])]


@pytest.mark.parametrize("rule", ["start", "majority"])
def test_section_counts(spark, docs, rule):
    path = P.path("byte_bpe_50k.tiktoken")
    enc, width = token_counts.ranks_codec(path, P.PATTERN)
    got = {}
    for r in token_counts.section_tokens(docs.dropDuplicates(["doc_id"]), path, P.PATTERN, rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d in docs.dropDuplicates(["doc_id"]).collect():
        t, rows = d.text or "", sorted(got[d.doc_id], key=lambda r: r.section)
        assert rows[0].start == 0 and rows[-1].stop == len(t) and all(a.stop == b.start for a, b in zip(rows, rows[1:]))
        raw, at, want = t.encode(), 0, [0] * len(rows)
        for i in enc.encode_ordinary(t):
            b = raw[at : at + int(width[i])]
            first = len(raw[:at].decode(errors="ignore"))
            chars = range(first, len(raw[: at + len(b)].decode(errors="ignore")) if (raw + b"a")[at + len(b)] & 0xC0 != 0x80 else first + max(1, len(b.decode(errors="ignore")) + 1))
            held = [sum(r.start <= c < r.stop for c in chars) for r in rows]
            k = next(j for j, h in enumerate(held) if h) if rule == "start" else held.index(max(held))
            want[k] += 1
            at += len(b)
        assert sum(r.n_tokens for r in rows) == len(enc.encode_ordinary(t))
        if t.isascii():
            assert [r.n_tokens for r in rows] == want


def test_edges_of_section_counts(spark, docs):
    path = P.path("byte_bpe_50k.tiktoken")
    twice = spark.createDataFrame([(1, "a\n\nb c"), (1, "a\n\nb c"), (None, "x"), (2, None)], "doc_id long, text string").withColumn("section", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    got = sorted(map(str, token_counts.section_tokens(twice, path, P.PATTERN, "start").select("doc_id", "section", "n_tokens").collect()))
    once = sorted(map(str, token_counts.section_tokens(twice.limit(1), path, P.PATTERN, "start").select("doc_id", "section", "n_tokens").collect()))
    assert all(got.count(r) == 2 for r in once) and len(got) == 2 * len(once) + 2
    assert token_counts.section_tokens(twice.limit(0), path, P.PATTERN, "start").count() == 0


def test_pieces_of_nothing(docs):
    assert piece_codec.encode_decode(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def test_parts_after_a_line_end_are_checked():
    c = piece_codec.PieceCodec(P.path("piece_bpe_32k.model"))
    c.encode("hello\nzebrafish question\n  two  spaces \n\n")
    assert "zebrafish" in c.new
    c.check()
    assert c.new == []
    c["zebrafish"] = c["question"]
    c.new.append("zebrafish")
    with pytest.raises(AssertionError):
        c.check()
