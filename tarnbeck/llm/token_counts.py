"""Operator 3, token counts by offset-mapped attribution.

Each whole document is encoded once; the tokens' character spans are interval-joined to the spans of its sections, and a
token that lies across a boundary goes to a section by a stated rule:

start     the section that holds the token's first character (or lies nearest before it);
majority  the section that holds most of its characters, of equal ones the earlier.

Sections are the document's lines unless spans are given. A null or empty text has one empty section with no tokens. Every
token is given to exactly one section, so a document's counts add up to its tokens. Repeated rows each give their rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table


@lru_cache(2)
def ranks_codec(path: str, pattern: str):
    """(tiktoken encoding, bytes of each token id)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width


def line_spans(text: str) -> np.ndarray:
    """Where each line ends (exclusive, with its line end), in characters; the last one ends the text."""
    ends, at = [], text.find("\n")
    while at >= 0:
        ends.append(at + 1)
        at = text.find("\n", at + 1)
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    return np.array(ends, np.int64)


def char_index(raw: bytes, text: str) -> np.ndarray | None:
    """Character that each byte belongs to, and the number of characters at the end; None where they are the same."""
    if len(raw) == len(text):
        return None
    lead = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    return np.r_[np.cumsum(lead) - 1, len(text)]


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Section of each token; starts and ends are in characters, bounds are the sections' ends."""
    first = np.minimum(np.searchsorted(bounds, starts, side="right"), len(bounds) - 1)
    if rule == "start":
        return first
    last = np.maximum(first, np.minimum(np.searchsorted(bounds, ends - 1, side="right"), len(bounds) - 1))
    for i in np.flatnonzero(last > first):
        edges = np.r_[starts[i], bounds[first[i] : last[i]], ends[i]]
        first[i] += int(np.argmax(np.diff(edges)))
    return first


def section_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "majority", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, start, stop, n_tokens, n_crossing): tokens given to each section, and those of them that reach over its ends."""
    if rule not in ("start", "majority"):
        raise ValueError(f"unknown rule {rule!r}")
    src = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, width = ranks_codec(path, pattern)
        for b in batches:
            keys, cols = [], [[] for _ in range(5)]
            for i, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                raw = t.encode()
                edges = np.r_[0, np.cumsum(width[np.array(enc.encode_ordinary(t), np.int64)])] if t else np.zeros(1, np.int64)
                chars = char_index(raw, t)
                starts, ends = edges[:-1], edges[1:]
                if chars is not None:
                    starts, ends = chars[starts], chars[ends - 1] + 1
                bounds = line_spans(t)
                at = attribute(starts, ends, bounds, rule)
                begin = np.r_[0, bounds[:-1]]
                over = (starts < begin[at]) | (ends > bounds[at])
                keys += [i] * len(bounds)
                for c, v in zip(cols, (np.arange(len(bounds)), begin, bounds, np.bincount(at, minlength=len(bounds)), np.bincount(at, weights=over, minlength=len(bounds)).astype(np.int64)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keys, pa.int64())), *(pa.array(np.concatenate(c) if c else [], pa.int64()) for c in cols)], names=[key, "section", "start", "stop", "n_tokens", "n_crossing"])

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{key}` {kind}, section long, start long, stop long, n_tokens long, n_crossing long")


def op3_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None, rule: str = "majority") -> DataFrame:
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, rule)
