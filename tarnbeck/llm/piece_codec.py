"""Operator 10, SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

An agenda holds every adjacent pair of symbols whose join is a piece, ordered by the piece's score and then by place; the
best pair is merged, its neighbours form new pairs, stale entries are passed over. Symbols that are no piece fall back to
their bytes. A text falls apart where no piece of the vocabulary could ever join two neighbouring characters, so segments
are encoded once and remembered in a table of bounded size, of which the half last used outlives the other. In every Arrow batch, all parts with a segment that was new to the
table are encoded by the sentencepiece library as well, and a difference raises; a part that no space leads is checked where it
follows a line end.

Nulls count as empty texts, which give no ids and decode to an empty text; repeated rows each give their row; columns of
the input beside the named ones are carried, those called ids or decoded are replaced.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, slices, table

#: Segments that each of the two halves of one Python worker's table holds, beside those of the last slice of a batch: about
#: 200 bytes each. Fewer take less memory and more time, as rarer segments are encoded again.
TABLE_SIZE = 400_000
_PART = re.compile(r" *[^ \n]+| +|\n")


class PieceCodec(dict):
    """Part of a text (spaces lead) -> its ids as native 32-bit integers."""

    def __init__(self, path: str, size: int = TABLE_SIZE):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        m, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i))]
        self.id = {m.id_to_piece(i): i for i in plain}
        #: What the agenda is ordered by: the best score is the smallest number.
        self.rank = {m.id_to_piece(i): -m.get_score(i) for i in plain}
        byte = {m.id_to_piece(i): i for i in range(n) if m.is_byte(i)}
        self.bytes = [byte.get(f"<0x{b:02X}>", m.unk_id()) for b in range(256)]
        if any("\n" in p or re.search("[^▁]▁", p) for p in self.id):
            raise ValueError("pieces with inner spaces or line ends are not supported")
        self.joins = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        #: The older half: a segment found there moves to the newer one, which is this dict.
        self.old: dict[str, bytes] = {}
        self.size, self.new = size, []

    def agenda(self, part: str) -> list[int]:
        """The ids of a part, spaces written as U+2581."""
        symbols, rank = list(part), self.rank
        n = len(symbols)
        heap = []
        for i in range(n - 1):
            p = symbols[i] + symbols[i + 1]
            if p in rank:
                heap.append((rank[p], i, p))
        if heap:
            heapq.heapify(heap)
            before, after = list(range(-1, n)), list(range(1, n + 1))
            symbols.append("")  # stands after the last one and joins nothing
            while heap:
                _, i, p = heapq.heappop(heap)
                a, j = symbols[i], after[i]
                if not a or j >= n or a + symbols[j] != p:
                    continue  # one of the two has been merged since
                symbols[i], symbols[j] = p, ""
                after[i] = k = after[j]
                before[k] = i
                if k < n and (q := p + symbols[k]) in rank:
                    heapq.heappush(heap, (rank[q], i, q))
                h = before[i]
                if h >= 0 and (q := symbols[h] + p) in rank:
                    heapq.heappush(heap, (rank[q], h, q))
        ids: list[int] = []
        for s in symbols:
            if s:
                i = self.id.get(s)
                if i is None:
                    ids.extend(self.bytes[b] for b in s.encode())
                else:
                    ids.append(i)
        return ids

    def __missing__(self, part: str) -> bytes:
        ids = self.old.pop(part, None)
        if ids is not None:
            self[part] = ids
            return ids
        text, joins = part.replace(" ", "▁"), self.joins
        cut = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joins]
        if cut:
            pieces = [part[a:b] for a, b in zip([0, *cut], [*cut, len(text)], strict=True)]
            fresh = any(p not in self and p not in self.old for p in pieces)
            ids = b"".join([self.segment(p) for p in pieces])
        else:
            ids, fresh = self.segment(part), True
        if fresh:
            self.new.append(part)
        if len(part) <= 64:
            self[part] = ids
        return ids

    def segment(self, part: str) -> bytes:
        """The ids of a part that no join crosses the ends of; checked with the part that it belongs to."""
        ids = self.get(part)
        if ids is None:
            ids = self.old.pop(part, None)
            if ids is None:
                ids = array("i", self.agenda(part.replace(" ", "▁"))).tobytes()
            if len(part) <= 64:
                self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, _PART.findall(" " + text.replace("▁", " ")))) if text else b""

    def check(self) -> None:
        """Holds the parts with segments that are new since the last call against the library."""
        # the library puts a space before a text; after a line end none is put
        whole = [p[1:] if p[0] == " " and len(p) > 1 else "\n" + p.strip(" \n") for p in self.new]
        for part, ids in zip(whole, self.library.encode(whole, num_threads=1), strict=True):
            if array("i", ids).tobytes() != b"".join(bytes(self[p]) for p in _PART.findall(" " + part)):
                raise AssertionError(f"agenda and library differ on {part!r}")
        self.new = []
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


@lru_cache(2)
def codec(path: str, size: int) -> PieceCodec:
    return PieceCodec(path, size)


def encode_decode(docs: DataFrame, path: str, text: str = "text", size: int = TABLE_SIZE) -> DataFrame:
    """docs with ids array<int> and decoded string, the library's decode(ids), in place of the text."""
    rest = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    src = docs.select(*rest, F.col(text).alias("decoded"))
    schema = T.StructType([*src.select(*rest).schema, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, size)
        for b in slices(batches, "decoded", 100):
            ids = [np.frombuffer(c.encode(t or ""), np.int32) for t in b.column("decoded").to_pylist()]
            c.check()
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            decoded = [c.library.decode(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in rest), lists, pa.array(decoded, pa.string())], names=[*rest, "ids", "decoded"])

    return src.mapInArrow(lean(run), schema)


def op10_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    coded = encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path or public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
