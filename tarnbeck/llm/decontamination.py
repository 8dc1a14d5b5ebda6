"""Operator 9, benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects from consecutive positions; the positions it leaves out may differ.
The seeds of all documents are joined with those of the benchmark; every hit names a document, an item and the shift between
their positions. Along that shift the two word sequences are compared: the document is contaminated by the item where a
window of 13 words holds at least 10 equal ones. The three masks hit every such window, whichever 3 words are replaced.
Items of fewer than 13 words must agree in all but 3 of 13 of their words, rounded down; they are searched with the masks
11 and 1, which hit all of those. Words are runs of letters and digits, A-Z folded.

The benchmark's seeds are broadcast while there are at most `broadcast_rows` of them, and joined by a shuffle beyond that;
so are the documents to verify. Everything runs in DataFrame functions.

Nulls and texts without words match nothing; a null key is kept; rows with equal key and text give one result, and go or stay
together; rows that share a key and differ in text are judged each; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, written

#: Positions that count, from the first to the last of each mask.
MASKS = ("110111", "1101000011", "111011")
SHORT_MASKS = ("11", "1")
WINDOW, EQUAL = 13, 10
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    # letters outside A-Z stay as they are
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def seeds(hashes: Column, masks: tuple[str, ...]) -> Column:
    """array<struct<at, seed>> of all masks; hashes: of the words."""

    def of(w: Column, n: int, mask: str) -> Column:
        taken = [i for i, c in enumerate(mask) if c == "1"]
        # positions whose mask runs over the end are none: get() gives null there, and null adds nothing to a hash
        made = F.transform(w, lambda x, i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), x, *(F.get(w, i + k) for k in taken[1:])).alias("seed")))
        return F.slice(made, F.lit(1), F.greatest(F.size(w) - len(mask) + 1, F.lit(0)))

    return bound(hashes, lambda w: F.concat(*(of(w, len(m) * 1000 + int(m, 2), m) for m in masks)))


def version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    broadcast_rows: int = BROADCAST_ROWS,
    with_version: bool = False,
) -> DataFrame:
    """(key, item, doc_start, doc_stop, item_start, n_equal, n_words): the aligned stretch of words in document and item.

    One row for each document, item and shift; n_words is the length of the stretch, n_equal its equal words. With
    with_version the row also has `version`, which tells texts of one key apart.
    """
    items = written(benchmark.select(F.col(item).alias("item"), words(F.col(item_text)).alias("item_words")).where(F.size("item_words") > 0), "items")
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    n = F.size("item_words")
    known = [items.where(n >= WINDOW).select("item", F.explode(seeds(hashed(F.col("item_words")), MASKS)).alias("s"))]
    masks = MASKS
    if not items.where(n < WINDOW).isEmpty():
        masks = MASKS + SHORT_MASKS
        known += [items.where((n < WINDOW) & (n > 1)).select("item", F.explode(seeds(hashed(F.col("item_words")), SHORT_MASKS[:1])).alias("s")), items.where(n == 1).select("item", F.explode(seeds(hashed(F.col("item_words")), SHORT_MASKS[1:])).alias("s"))]
    for extra in known[1:]:
        known[0] = known[0].unionByName(extra)
    known = written(known[0].select("item", F.col("s.at").alias("item_at"), F.col("s.seed").alias("seed")), "seeds")
    src = docs.select(F.col(key).alias("key"), version(F.col(text)).alias("version"), F.col(text).alias("text"))
    mine = src.select("key", "version", F.explode(seeds(hashed(words(F.col("text"))), masks)).alias("s")).select("key", "version", F.col("s.at").alias("at"), F.col("s.seed").alias("seed"))
    hits = written(mine.join(small(known, broadcast_rows), "seed").select("key", "version", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct(), "hits")
    wanted = small(written(hits.select("key", "version").distinct(), "wanted"), broadcast_rows)
    same = lambda a, b: a["key"].eqNullSafe(b["key"]) & (a["version"] == b["version"])
    read = src.join(wanted, same(src, wanted), "left_semi").dropDuplicates(["key", "version"]).select("key", "version", words(F.col("text")).alias("doc_words"))
    pairs = read.join(hits, same(read, hits)).select(read["key"], read["version"], "doc_words", "item", "shift").join(small(items, broadcast_rows // 10), "item")
    from_item = F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(n, F.size("doc_words") - F.col("shift")) - from_item
    cut = lambda c, at: F.slice(c, at + 1, F.greatest(length, F.lit(0)))
    flags = F.zip_with(cut(F.col("item_words"), from_item), cut(F.col("doc_words"), from_item + F.col("shift")), lambda a, b: (a == b).cast("int"))
    width = F.least(n, F.lit(WINDOW))
    pairs = pairs.select("key", "version", "item", (from_item + F.col("shift")).alias("doc_start"), from_item.alias("item_start"), length.alias("n_words"), flags.alias("flags"), width.alias("width"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.greatest(F.col("n_words") - F.col("width") + 1, F.lit(1))), lambda i: total(F.slice("flags", i, F.col("width")))))
    needed = F.col("width") - F.floor(F.col("width") * (WINDOW - EQUAL) / WINDOW)
    return pairs.where((F.col("n_words") >= F.col("width")) & (best >= needed)).select(
        *["version"] * with_version,
        F.col("key").alias(key), F.col("item").alias(item), F.col("doc_start").cast("long"), (F.col("doc_start") + F.col("n_words")).cast("long").alias("doc_stop"), F.col("item_start").cast("long"), total(F.col("flags")).cast("long").alias("n_equal"), F.col("n_words").cast("long")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that no benchmark item overlaps."""
    found = overlaps(docs, benchmark, key, text, with_version=True).select(F.col(key).alias("__key"), F.col("version").alias("__version")).distinct()
    found = small(written(found, "contaminated"), BROADCAST_ROWS)
    return docs.join(found, docs[key].eqNullSafe(found["__key"]) & (version(docs[text]) == found["__version"]), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
